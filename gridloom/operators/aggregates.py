"""Segment statistics, pivots, cohorts, duplicates, keys, concentration and cross tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.plans.ordered import grouped_quantiles, running_before
from gridloom.plans.stacked import stack_text
from gridloom.session import settle

GRAND_TOTAL = "Grand Total"


def segment_stats(df: DataFrame, segment: str, metric: str, digits: int = 4) -> DataFrame:
    """Count, mean, median, std, min and max of a metric per segment; null segments are left out."""
    rows = df.where(F.col(segment).isNotNull())
    moments = rows.groupBy(segment).agg(
        F.count(metric).alias("count"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"),
        F.min(metric).cast("double").alias("min"), F.max(metric).cast("double").alias("max"),
    )
    medians = grouped_quantiles(rows, [segment], metric, {"median": 0.5}).drop("n")
    return moments.join(medians, segment, "left").select(
        F.col(segment).alias("segment"), "count",
        *[F.round(c, digits).alias(c) for c in ("mean", "median", "std", "min", "max")],
    )


def _pivot_cells(df: DataFrame, rows: Sequence[str], cols: Sequence[str], values: str, agg: str) -> DataFrame:
    """Long cells ``rows…, cols…, value`` with the margins as groups of their own (null where rolled up)."""
    dims = [*rows, *cols]
    sets = [dims, list(rows), list(cols), []] if cols else [dims, []]
    data = df.where(F.col(values).isNotNull())
    for d in dims:
        data = data.where(F.col(d).isNotNull())
    if agg == "median":
        parts = []
        for s in sets:
            part = grouped_quantiles(data, s, values, {"value": 0.5}).drop("n")
            parts.append(part.select(*[F.col(d) if d in s else F.lit(None).cast("string").alias(d) for d in dims], "value"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
    if agg == "std":
        return data.groupingSets(sets, *dims).agg(F.stddev_samp(values).alias("value"))
    # Sums, counts and extremes of the margins come from the cells, so input rows are read and shuffled once.
    cells = data.groupBy(*dims).agg(
        F.count(values).alias("n"), F.sum(F.col(values).cast("double")).alias("s"),
        F.min(values).alias("lo"), F.max(values).alias("hi"),
    )
    value = {
        "sum": F.sum("s"), "mean": F.sum("s") / F.sum("n"), "count": F.sum("n").cast("double"),
        "min": F.min("lo").cast("double"), "max": F.max("hi").cast("double"),
    }[agg]
    return cells.groupingSets(sets, *dims).agg(value.alias("value"))


def pivot(
    df: DataFrame, rows: Sequence[str], cols: Sequence[str], values: str, agg: str = "sum", top_n: int | None = None,
) -> DataFrame:
    """Pivot table with margins computed from the raw rows: all rows, or the ``top_n`` by grand total, plus the total row.

    Rows and columns of the data may have the margin's label: margins are known by what is rolled up (data labels are never
    null), and such a data column is named with ``(data)`` behind it.
    """
    label = F.concat_ws(" | ", *[F.col(c).cast("string") for c in cols])
    rolled = F.col(cols[0]).isNull() if cols else F.lit(True)
    long = _pivot_cells(df, rows, cols, values, agg).select(
        F.col(rows[0]).isNull().alias("_total"),
        *[F.coalesce(F.col(r).cast("string"), F.lit(GRAND_TOTAL)).alias(r) for r in rows],
        F.when(rolled, GRAND_TOTAL).when(label == GRAND_TOTAL, f"{GRAND_TOTAL} (data)").otherwise(label).alias("_c"),
        F.round("value", 4).alias("value"),
    )
    wide = long.groupBy("_total", *rows).pivot("_c").agg(F.first("value")).na.fill(0.0)
    body = wide.where(~F.col("_total")).orderBy(F.desc(GRAND_TOTAL), *rows)
    body = body if top_n is None else body.limit(top_n)
    return body.unionByName(wide.where("_total")).drop("_total")


def append_total(df: DataFrame, label: str, measures: Sequence[str]) -> DataFrame:
    """The table with a row of column sums appended."""
    total = df.agg(F.lit(GRAND_TOTAL).alias(label), *[F.sum(m).alias(m) for m in measures])
    return df.select(F.col(label).cast("string").alias(label), *measures).unionByName(total)


def rfm_base(df: DataFrame, customer: str, date: str, revenue: str) -> DataFrame:
    """Recency, frequency and monetary value per customer; recency counts back from the latest date of all."""
    rows = df.where(F.col(customer).isNotNull() & F.col(date).isNotNull() & F.col(revenue).isNotNull())
    asof = rows.agg(F.max(date)).scalar()
    return rows.groupBy(customer).agg(
        F.max(date).alias("last_date"), F.count(F.lit(1)).alias("frequency"), F.sum(revenue).alias("monetary")
    ).withColumn("recency_days", F.datediff(asof, "last_date").cast("bigint")).drop("last_date")


def rfm_scores(base: DataFrame, customer: str) -> DataFrame:
    """Quintile scores 1..5 by interpolated, right-closed edges; everyone gets 3 where edges collide."""
    measures = ["recency_days", "frequency", "monetary"]
    base = settle(base)
    long = base.select(*[F.col(m).cast("double").alias(m) for m in measures]).unpivot([], measures, "column", "value")
    probs = {f"e{i}": i / 5 for i in range(6)}
    # Eighteen numbers, whatever the size of the table: read once and put into the plan as literals.
    edges = {row["column"]: [row[f"e{i}"] for i in range(6)] for row in grouped_quantiles(long, ["column"], "value", probs, few_keys=True).collect()}
    out = base
    for m, short, flip in zip(measures, ("r", "f", "m"), (True, False, False)):
        e = edges.get(m, [])
        if len(set(e)) < 6:
            score = F.lit(3)
        else:
            level = reduce(lambda x, y: x + y, [(F.lit(e[i]) < F.col(m)).cast("int") for i in range(1, 5)]) + 1
            score = 6 - level if flip else level
        out = out.withColumn(f"{short}_score", score.cast("bigint"))
    r, f = F.col("r_score"), F.col("f_score")
    segment = (
        F.when((r >= 4) & (f >= 4), "Champions").when((f >= 4) & (r >= 3), "Loyal")
        .when((r >= 4) & (f == 1), "New Customer").when((r >= 4) & (f <= 3), "Potential Loyalist")
        .when((r <= 2) & (f >= 3), "At Risk").when((r <= 2) & (f <= 2), "Lost").otherwise("Promising")
    )
    return out.withColumn("rfm_score", r + f + F.col("m_score")).withColumn("segment", segment).withColumn(
        "monetary", F.round("monetary", 2)
    )


def rfm_segment_stats(scored: DataFrame) -> DataFrame:
    return scored.groupBy("segment").agg(
        F.count(F.lit(1)).alias("count"), F.round(F.avg("monetary"), 2).alias("avg_monetary"),
        F.round(F.avg("frequency"), 2).alias("avg_frequency"), F.round(F.avg("recency_days"), 1).alias("avg_recency_days"),
        F.round(F.sum("monetary"), 2).alias("total_revenue"),
    )


def retention(df: DataFrame, cohort: str, period: str, user: str) -> DataFrame:
    """Active distinct users per (cohort, period) over the cohort's size, in long form."""
    rows = df.where(F.col(cohort).isNotNull() & F.col(period).isNotNull() & F.col(user).isNotNull())
    seen = rows.select(cohort, period, user).distinct()
    sizes = seen.select(cohort, user).distinct().groupBy(cohort).agg(F.count(F.lit(1)).alias("cohort_size"))
    active = seen.groupBy(cohort, period).agg(F.count(F.lit(1)).alias("active"))
    return active.join(sizes, cohort).withColumn("rate", F.round(F.col("active") / F.col("cohort_size"), 4))


def retention_matrix(df: DataFrame, cohort: str, period: str, user: str) -> DataFrame:
    """One row per cohort, one column per period, null where nobody was active."""
    return retention(df, cohort, period, user).groupBy(cohort, "cohort_size").pivot(period).agg(F.first("rate"))


def exact_duplicates(df: DataFrame, row_id: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Groups of identical rows: size, first id and the ids of the further copies as rows of their own.

    The group's ids are kept long (one row per id), so a group of any size stays spread out.
    """
    cols = list(cols or [c for c in df.columns if c != row_id])
    keyed = df.select(row_id, F.xxhash64(*cols).alias("_h"), *cols)
    groups = keyed.groupBy("_h", *cols).agg(F.count(F.lit(1)).alias("copies"), F.min(row_id).alias("first_id"))
    multi = groups.where(F.col("copies") > 1)
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"g.{c}")) for c in cols]
    return keyed.alias("k").join(multi.alias("g"), [F.col("k._h") == F.col("g._h"), *same]).select(
        F.col("g.first_id").alias("first_id"), F.col(f"k.{row_id}").alias("row_id"), F.col("g.copies").alias("copies")
    )


def duplicate_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows, surplus copies and their share, and the number of groups."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).agg(
        F.sum("n").alias("total_rows"), (F.sum("n") - F.count(F.lit(1))).alias("duplicate_rows"),
        F.round((F.sum("n") - F.count(F.lit(1))) / F.sum("n") * 100, 2).alias("duplicate_pct"),
        F.count_if(F.col("n") > 1).alias("duplicate_groups"),
    )


def natural_keys(df: DataFrame, pair_columns: int | None = None) -> DataFrame:
    """Candidate keys: every single column, then pairs (of the first ``pair_columns``, if given), with distinct counts.

    Pairs whose two columns cannot reach the row count (product of approximate distinct counts) are ruled out before
    the exact count.
    """
    total = df.count()
    cols = df.columns
    approx = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols],
                    *[F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in cols]).first()
    whole = [c for c in cols if approx[f"_null_{c}"] == 0]
    cand = [(c,) for c in whole if approx[c] >= 0.7 * total]
    cand += [p for p in combinations(cols[:pair_columns], 2)
             if all(c in whole for c in p) and approx[p[0]] * approx[p[1]] >= 0.7 * total]
    if not cand:
        return df.sparkSession.createDataFrame([], "columns string, n_columns bigint, n_distinct bigint, is_key boolean")
    hashed = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("k"), F.array(*[F.col(c).cast("string") for c in p]).alias("v"))
        for i, p in enumerate(cand)
    ])).alias("s")).select("s.k", "s.v").distinct().groupBy("k").agg(F.count(F.lit(1)).alias("n_distinct"))
    names = F.array(*[F.lit(",".join(p)) for p in cand])
    sizes = F.array(*[F.lit(len(p)) for p in cand])
    return hashed.select(
        F.element_at(names, F.col("k") + 1).alias("columns"), F.element_at(sizes, F.col("k") + 1).cast("bigint").alias("n_columns"),
        "n_distinct", (F.col("n_distinct") == total).alias("is_key"),
    )


def concentration(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Share of a column's total held by its top 10 % and top 20 % of rows (positive totals only)."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "column", "value")
    long = long.where(F.col("value").isNotNull())
    size = long.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("c"))
    placed = running_before(
        counts.withColumn("neg", -F.col("value")), ["column"], "neg", "c", few_keys=True
    )
    def share(frac):
        k = F.greatest(F.floor(F.col("total") * frac), F.lit(1))
        taken = F.greatest(F.least(F.col("c"), k - F.col("before")), F.lit(0))
        return F.sum(taken * F.col("value"))
    tops = placed.groupBy("column").agg(share(0.1).alias("top10"), share(0.2).alias("top20"))
    return size.join(F.broadcast(tops), "column").where((F.col("total") > 0)).select(
        "column", "n",
        F.round(F.col("top10") / F.col("total"), 4).alias("top10_share"),
        F.round(F.col("top20") / F.col("total"), 4).alias("top20_share"),
    )


def category_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``column, value, n`` of all category columns from one shuffle."""
    return stack_text(df, cols).where(F.col("value").isNotNull()).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n")
    )


def dominance_and_entropy(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Top value and its share, the >70 % dominance flag and the Shannon entropy in bits."""
    counts = category_counts(df, cols)
    totals = counts.groupBy("column").agg(
        F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("nlogn"), F.count(F.lit(1)).alias("levels"),
        F.max_by("value", F.struct(F.col("n"))).alias("any_top"), F.max("n").alias("top_n"),
    )
    return totals.select(
        "column", "levels", F.round(F.col("top_n") / F.col("total"), 4).alias("top_share"),
        (F.col("top_n") / F.col("total") > 0.7).alias("dominant"),
        F.round(F.log2("total") - F.col("nlogn") / F.col("total"), 4).alias("entropy"),
    )


def group_rare(df: DataFrame, col: str, top: int, out: str) -> DataFrame:
    """``col`` with all but its ``top`` most frequent values replaced by "(Other)"."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    keep = counts.orderBy(F.desc("_n"), col).limit(top).select(F.col(col).alias("_keep"))
    return df.join(F.broadcast(keep), F.col(col) == F.col("_keep"), "left").withColumn(
        out, F.when(F.col("_keep").isNotNull(), F.col(col)).when(F.col(col).isNotNull(), "(Other)")
    ).drop("_keep")


def crosstab(df: DataFrame, a: str, b: str, top: int = 8) -> DataFrame:
    """Counts and row percents of two category columns after grouping rare values."""
    both = df.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    grouped = group_rare(group_rare(both, a, top, "row"), b, top, "col")
    cells = grouped.groupBy("row", "col").agg(F.count(F.lit(1)).alias("value"))
    full = cells.select("row").distinct().withColumn("cols", F.lit(None)).drop("cols")
    # At most (top + 1)^2 cells: absent combinations are filled from the value lists.
    levels = cells.agg(F.collect_set("col")).scalar()
    grid = full.withColumn("col", F.explode(levels))
    row_total = Window.partitionBy("row")
    return grid.join(cells, ["row", "col"], "left").select(
        "row", "col", F.coalesce("value", F.lit(0)).alias("value"),
        F.round(F.coalesce("value", F.lit(0)) / F.greatest(F.sum("value").over(row_total), F.lit(1)) * 100, 1).alias("row_pct"),
    )
