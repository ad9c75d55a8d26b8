"""Chart-ready aggregates: every function returns the points of a chart as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.moments import correlation_of


def leaderboard(df: DataFrame, label: str, value: str, n: int = 10, descending: bool = True) -> DataFrame:
    """Top rows by value with trimmed, non-empty labels."""
    order = F.col("value").desc() if descending else F.col("value").asc()
    return df.select(F.trim(label).alias("label"), F.col(value).alias("value")).where(
        F.col("value").isNotNull() & (F.col("label") != "")
    ).orderBy(order, "label").limit(n)


def top_values(df: DataFrame, col: str, n: int) -> DataFrame:
    """The ``n`` most frequent values and the sum of the rest as "Other"."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )
    top = counts.orderBy(F.desc("n"), "label").limit(n)
    rest = counts.join(F.broadcast(top.select("label")), "label", "left_anti").agg(F.sum("n").alias("n"))
    return top.unionByName(rest.where(F.col("n") > 0).select(F.lit("Other").alias("label"), "n"))


# --- series, histogram, category, scatter, box and heat-map points -----------------------------------------------------

MAX_CHARTS = 10
MAX_SCATTER, MAX_BOX_OUTLIERS = 300, 20
# Name parts of columns that are never drawn over time.
BLOCKED_OVER_TIME = ["previous_accident", "prior_accident", "num_accident", "accident_count", "num_dependents", "number_of_dependents",
                     "number_of_children", "family_size", "household_size", "vehicle_year", "model_year"]


def line_points(df: DataFrame, date: str, value: str) -> DataFrame:
    """Daily means with the two-sigma flag, overall mean and median; empty when the axis or the values are too poor.

    The axis needs four values on three days, the values three distinct numbers and a name that suits a trend.
    """
    from gridloom.operators.series import points
    from gridloom.plans.ordered import grouped_quantiles

    name = value.lower()
    if any(b in name for b in BLOCKED_OVER_TIME) or "age" in name.split("_"):
        return points(df, date, value).where("false").select("date", F.col("value").alias("y"), F.lit(False).alias("is_anomaly"))
    pts = points(df.withColumn(date, F.date_trunc("day", date).cast("timestamp_ntz")), date, value)
    gate = df.where(F.col(date).isNotNull() & F.col(value).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(value).alias("k")).select(
        (F.col("n") >= 4) & (F.col("k") >= 3))
    s = pts.agg(F.struct(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.count(F.lit(1)).alias("days"))).scalar()
    med = grouped_quantiles(pts, [], "value", {"m": 0.5}).select("m").scalar()
    return pts.withColumn("_s", s).withColumn("_g", gate.scalar()).withColumn("_med", med).where("_g AND _s.days >= 3").select(
        "date", F.round("value", 4).alias("y"), (F.abs(F.col("value") - F.col("_s.m")) > 2 * F.col("_s.s")).alias("is_anomaly"),
        F.round("_s.m", 4).alias("mean"), F.round("_med", 4).alias("median"))


def histogram(df: DataFrame, col: str) -> DataFrame:
    """8, 10 or 12 equal bins by row count, with share and the flag of bins centred outside the 1.5 IQR fences."""
    from gridloom.plans.ordered import grouped_quantiles

    v = df.select(F.col(col).cast("double").alias("v")).where("v IS NOT NULL")
    q = grouped_quantiles(v, [], "v", {"q1": 0.25, "q3": 0.75}).select(F.struct("q1", "q3")).scalar()
    s = v.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))).scalar()
    d = v.withColumn("_s", s)
    bins = F.when(F.col("_s.n") > 500, 12).when(F.col("_s.n") > 120, 10).otherwise(8)
    width = (F.col("_s.hi") - F.col("_s.lo")) / bins
    at = F.least(F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("_s.lo"), width)), F.lit(0)), bins - 1)
    h = d.groupBy(at.cast("bigint").alias("bin"), "_s").agg(F.count(F.lit(1)).alias("value")).withColumn("_q", q)
    centre = F.col("_s.lo") + (F.col("bin") + 0.5) * width
    iqr = F.col("_q.q3") - F.col("_q.q1")
    return h.select("bin", "value", F.round(F.col("value") / F.col("_s.n"), 4).alias("density"),
                    ((centre < F.col("_q.q1") - 1.5 * iqr) | (centre > F.col("_q.q3") + 1.5 * iqr)).alias("is_anomaly_bin"))


def shares(df: DataFrame, col: str, most: int | None = None) -> DataFrame:
    """Counts and shares of a column with two values or more (nothing beyond ``most`` values, if given: pie and binary bars); nulls
    count as "(missing)"."""
    c = df.groupBy(F.coalesce(F.col(col).cast("string"), F.lit("(missing)")).alias("name")).agg(F.count(F.lit(1)).alias("value"), F.count(col).alias("_f"))
    t = c.agg(F.struct(F.sum("value").alias("n"), F.count_if(F.col("_f") > 0).alias("k"))).scalar()
    return c.withColumn("_t", t).where((F.col("_t.k") >= 2) & (F.col("_t.k") <= most if most is not None else F.lit(True))).select("name", "value", F.round(F.col("value") / F.col("_t.n") * 100, 1).alias("pct"))


def scatter_sample(df: DataFrame, row_id: str, x: str, y: str, n: int = MAX_SCATTER) -> DataFrame:
    """At most ``n`` rows, chosen by hashed id, with the residual flag of the line fitted to all rows."""
    from gridloom.operators.correlation import residual_flags

    return residual_flags(df, row_id, x, y).orderBy(F.md5(F.concat(F.lit("42:"), F.col(row_id).cast("string"))), row_id).limit(n)


def box_whiskers(df: DataFrame, cat: str, num: str, most_outliers: int | None = None) -> DataFrame:
    """Quartiles, whiskers inside the 1.5 IQR fences and outliers (the ``most_outliers`` lowest, if given; else their number and
    the lowest one, so no list grows with the data) for two groups or more of four rows up."""
    from pyspark.sql import Window

    from gridloom.plans.ordered import grouped_quantiles

    rows = df.select(F.col(cat).cast("string").alias("name"), F.col(num).cast("double").alias("v")).where("name IS NOT NULL AND v IS NOT NULL")
    q = grouped_quantiles(rows, ["name"], "v", {"q1": 0.25, "median": 0.5, "q3": 0.75}).where("n >= 4")
    groups = rows.agg(F.count_distinct("name")).scalar()
    q = q.withColumn("_g", groups).where(F.col("_g") >= 2).drop("_g")
    iqr = F.col("q3") - F.col("q1")
    lo, hi = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    j = rows.join(q, "name")
    ends = j.groupBy("name").agg(F.min(F.when(F.col("v") >= lo, F.col("v"))).alias("min"), F.max(F.when(F.col("v") <= hi, F.col("v"))).alias("max"))
    far = j.where((F.col("v") < lo) | (F.col("v") > hi))
    if most_outliers is not None:
        far = far.withColumn("_r", F.row_number().over(Window.partitionBy("name").orderBy("v"))).where(F.col("_r") <= most_outliers)
    out = far.groupBy("name").agg(F.count(F.lit(1)).alias("_far"), F.min("v").alias("_low"))
    return q.join(ends, "name").join(out, "name", "left").select(
        "name", "n", *[F.round(c, 4).alias(c) for c in ("min", "q1", "median", "q3", "max")],
        F.coalesce("_far", F.lit(0)).cast("bigint").alias("n_outliers"), F.round("_low", 4).alias("lowest_outlier"))


def heat_map(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson r of every pair of columns on the complete rows, both ways round."""
    d = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).na.drop()
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    p = d.agg(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.coalesce(F.round(correlation_of(a, b), 3), F.lit(0.0)).alias("value")).alias(f"_{i}")
                for i, (a, b) in enumerate(pairs)]).select(F.inline(F.array(*[f"_{i}" for i in range(len(pairs))])))
    return p.select(F.col("a").alias("x"), F.col("b").alias("y"), "value").unionByName(
        p.where("a <> b").select(F.col("b").alias("x"), F.col("a").alias("y"), "value"))


def category_means(df: DataFrame, cat: str, num: str, least: int = 1) -> DataFrame:
    """Mean of a number per category with enough rows, best first."""
    return df.where(F.col(cat).isNotNull() & F.col(num).isNotNull()).groupBy(F.trim(cat).alias("label")).agg(
        F.count(F.lit(1)).alias("count"), F.round(F.avg(num), 4).alias("value")).where(F.col("count") >= least)


def pooled_histogram(df: DataFrame, col: str, bins: int = 12) -> DataFrame:
    """Equal bins of all values of a column (daily returns of a panel)."""
    v = df.select(F.col(col).cast("double").alias("v")).where("v IS NOT NULL")
    s = v.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi"))).scalar()
    d = v.withColumn("_s", s)
    at = F.least(F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("_s.lo"), (F.col("_s.hi") - F.col("_s.lo")) / bins)), F.lit(0)), F.lit(bins - 1))
    return d.groupBy(at.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("value"))


# --- candidates -----------------------------------------------------------------------------------------------------------

# Labels that are no column names, base scores per chart type and plan boosts.
GENERIC_LABELS = ["count", "frequency", "density", "value", "date", "label", "x", "y", "mean", "median", "percent", "index"]
BASE_SCORES = {"line": 9.0, "histogram": 8.0, "bar": 6.0, "binary": 6.0, "pie": 5.0, "boxplot": 7.0, "heatmap": 8.0}


def chart_scores(charts: DataFrame, plan: DataFrame) -> DataFrame:
    """Chart candidates of many runs with plan boosts: ``charts(run_id, seq, type, title, x_label, y_label, score)``,
    ``plan(run_id, column, use)`` with use ``target``, ``dimension``, ``time`` or ``ignore``."""
    cols = charts.select("run_id", "seq", F.explode(F.array_distinct(F.array_compact(F.array("x_label", "y_label")))).alias("column")).where(
        ~F.lower("column").isin(GENERIC_LABELS))
    u = cols.join(plan, ["run_id", "column"], "left").groupBy("run_id", "seq").agg(
        F.bool_and(F.coalesce(F.col("use") == "ignore", F.lit(False))).alias("ign"),
        *[F.bool_or(F.coalesce(F.col("use") == k, F.lit(False))).alias(k) for k in ("target", "dimension", "time")])
    j = charts.join(u, ["run_id", "seq"], "left").na.fill(False, ["ign", "target", "dimension", "time"])
    boost = (F.when(F.col("target") & F.col("dimension"), 1.5).when(F.col("target") & F.col("time"), 1.2).when(F.col("target"), 0.8)
             .when(F.col("dimension"), 0.3).otherwise(0.0))
    return j.withColumn("score", F.when(F.col("ign"), F.col("score") * 0.4).otherwise(F.col("score") + boost)).drop("ign", "target", "dimension", "time")


def rank_charts(charts: DataFrame, limit: int | None = None) -> DataFrame:
    """The best chart per (type, title, axes) of every run, by score: all, or the first ``limit``."""
    from pyspark.sql import Window

    row = F.struct(*charts.columns)
    one = charts.groupBy("run_id", "type", F.lower(F.trim("title")).alias("_t"), "x_label", "y_label").agg(
        F.min_by(row, F.struct(-F.col("score"), F.col("seq"))).alias("_r")).select("_r.*")
    w = Window.partitionBy("run_id").orderBy(F.desc("score"), "seq")
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit if limit is not None else F.lit(True)).withColumn("rank", F.col("rank").cast("bigint"))
