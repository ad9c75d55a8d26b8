"""Column profiles. All columns of a table share the passes: moments, distinct cells, quartiles, pattern rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.moments import chi2_sf_2df, k_squared, kurt_g2, skew_g1
from gridloom.functions.patterns import DATE_SHAPES, VALUE_PATTERNS
from gridloom.operators.aggregates import category_counts
from gridloom.operators.filters import distinct_counts, simple_type
from gridloom.plans.ordered import grouped_quantiles, running_before, with_previous
from gridloom.plans.stacked import date_columns, numeric_columns, stack_numbers, stack_text, text_columns, wide_to_rows
from gridloom.session import settle

TOP_VALUES = 10
PATTERN_MIN, PATTERN_STRONG = 50, 85


def kind_of(dtype: str) -> str:
    k = simple_type(dtype)
    return "numeric" if k in ("integer", "float") else "datetime" if k == "datetime" else "categorical"


def base_profile(df: DataFrame) -> DataFrame:
    """Per column: type, rows, missing and distinct counts with percents."""
    kinds = dict(df.dtypes)
    b = wide_to_rows(df, df.columns, {
        "type": lambda c: F.first(F.lit(kind_of(kinds[c]))), "rows": lambda c: F.count(F.lit(1)),
        "missing": lambda c: F.count_if(F.col(c).isNull()),
    }).join(F.broadcast(distinct_counts(df, df.columns)), "column", "left").na.fill(0, ["n_unique"])
    n = F.greatest("rows", F.lit(1))
    return b.select("column", "type", "rows", "missing", F.round(F.col("missing") / n * 100, 1).alias("missing_pct"),
                    F.col("n_unique").alias("unique"), F.round(F.col("n_unique") / n * 100, 1).alias("unique_pct"))


def outlier_counts(df: DataFrame, cols: Sequence[str], bounds: DataFrame) -> DataFrame:
    """Values outside the 1.5 IQR fences and beyond three population deviations, per column (4 and 3 values up)."""
    iqr = F.col("q75") - F.col("q25")
    v = F.col("value")
    # One row per column is broadcast.
    j = stack_numbers(df, cols).where("value IS NOT NULL").join(
        F.broadcast(bounds.select("column", "q25", "q75", "mean", "sd_pop", "n")), "column")
    return j.groupBy("column").agg(
        F.count_if((F.col("n") >= 4) & ((v < F.col("q25") - 1.5 * iqr) | (v > F.col("q75") + 1.5 * iqr))).alias("outliers_iqr"),
        F.count_if((F.col("n") >= 3) & (F.abs(v - F.col("mean")) > 3 * F.col("sd_pop"))).alias("outliers_zscore"))


def numeric_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or numeric_columns(df))
    base = wide_to_rows(df, cols, {
        "n": lambda c: F.count(c), "missing": lambda c: F.count_if(F.col(c).isNull()), "mean": lambda c: F.avg(c),
        "std": lambda c: F.stddev_samp(c), "sd_pop": lambda c: F.stddev_pop(c), "min": lambda c: F.min(c).cast("double"),
        "max": lambda c: F.max(c).cast("double"), "skewness": lambda c: F.coalesce(skew_g1(c), F.lit(0.0)),
        "kurtosis": lambda c: F.coalesce(kurt_g2(c), F.lit(0.0)), "zeros": lambda c: F.count_if(F.col(c) == 0),
    })
    q = grouped_quantiles(stack_numbers(df, cols), ["column"], "value", {"q25": 0.25, "median": 0.5, "q75": 0.75}, few_keys=True).drop("n")
    # Three tables of one row per column.
    wide = settle(base.join(q, "column").join(distinct_counts(df, cols), "column", "left"))
    out = wide.join(outlier_counts(df, cols, wide), "column", "left").na.fill(0, ["outliers_iqr", "outliers_zscore", "n_unique"])
    low = (F.col("n_unique") <= 5) & (F.col("n") > 20)
    mid = (F.col("n_unique") <= 15) & (F.col("n") > 50)
    return out.select(
        "column", "n", "missing", *[F.round(c, 4).alias(c) for c in ("mean", "median", "std", "min", "max", "q25", "q75")],
        F.round("skewness", 3).alias("skewness"), F.round("kurtosis", 3).alias("kurtosis"), "zeros", "n_unique",
        "outliers_iqr", "outliers_zscore", F.when(low, "low").when(mid, "medium").otherwise("high").alias("dtype_confidence"))


def normality_flags(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    m = wide_to_rows(df, cols, {"n": lambda c: F.count(c), "g1": lambda c: F.skewness(c), "g2": lambda c: F.kurtosis(c)})
    k = k_squared(F.col("n"), F.col("g1"), F.col("g2"))
    small = F.col("n") < 8
    return m.withColumn("_k", k).select(
        "column", "n", F.round(F.when(~small, F.col("_k")), 4).alias("k2"),
        F.round(F.when(small, 1.0).otherwise(chi2_sf_2df(F.col("_k"))), 4).alias("normality_p"),
        F.when(small, True).otherwise(chi2_sf_2df(F.col("_k")) > 0.05).alias("is_normal"))


def normal_cdf(z: Column) -> Column:
    """Normal distribution function by the five-term rational formula (error below 1e-7)."""
    x = F.abs(z) / 2 ** 0.5
    t = 1 / (1 + 0.3275911 * x)
    # Coefficients of the published approximation.
    poly = ((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592
    erf = 1 - poly * t * F.exp(-x * x)
    return 0.5 * (1 + F.signum(z) * erf)


def distribution_fit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Kolmogorov-Smirnov distances of normal, lognormal, Pareto and exponential laws, and the best one."""
    long = stack_numbers(df, cols).where("value IS NOT NULL")
    counts = settle(long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    w, v, lv = F.col("n"), F.col("value"), F.ln(F.when(F.col("value") > 0, F.col("value")))
    par = long.groupBy("column").agg(
        F.count(F.lit(1)).alias("size"), F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"), F.min("value").alias("lo"),
        F.avg(lv).alias("lm"), F.stddev_samp(lv).alias("lsd")).where("size >= 20 AND sd >= 1e-10")
    pos = F.col("lo") > 0
    placed = running_before(counts, ["column"], "value", "n", few_keys=True).join(F.broadcast(par), "column")
    alpha = 1 / (F.col("lm") - F.ln("lo"))
    laws = {
        "normal": normal_cdf((v - F.col("m")) / F.col("sd")),
        "lognormal": F.when(pos, normal_cdf((lv - F.col("lm")) / F.col("lsd"))),
        "pareto": F.when(pos, 1 - F.pow(F.col("lo") / v, alpha)),
        "exponential": F.when(F.col("lo") >= 0, 1 - F.exp(-v / F.col("m"))),
    }
    def distance(cdf):
        return F.max(F.greatest(cdf - F.col("before") / F.col("total"), (F.col("before") + w) / F.col("total") - cdf))
    d = placed.groupBy("column").agg(*[distance(c).alias(k) for k, c in laws.items()])
    best = F.array_min(F.array_compact(F.array(*[
        F.when(F.col(k).isNotNull(), F.struct(F.col(k).alias("d"), F.lit(i).alias("i"), F.lit(k).alias("name"))) for i, k in enumerate(laws)])))
    return d.withColumn("_b", best).select(
        "column", *[F.round(k, 4).alias(k) for k in laws], F.col("_b.name").alias("best_fit"), F.round("_b.d", 4).alias("ks_statistic"),
        F.col("_b.name").isin("lognormal", "pareto", "exponential").alias("transform_hint"))


def _days(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) for c in cols]).unpivot([], list(cols), "column", "value").where(
        "value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def _date_steps(counts: DataFrame) -> DataFrame:
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return with_previous(counts, ["column"], "value").withColumn("step", (us("value") - us("prev")) / 8.64e10)


def datetime_profile(df: DataFrame, as_of: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Range, frequency guess from the median step (repeated dates step by zero), gaps, freshness against ``as_of``."""
    cols = list(cols or date_columns(df))
    steps = settle(_date_steps(_days(df, cols)))
    repeats = steps.select("column", F.lit(0.0).alias("step"), (F.col("n") - 1).alias("w")).where("w > 0")
    real = steps.where("prev IS NOT NULL").select("column", "step", F.lit(1).cast("bigint").alias("w"))
    med_all = grouped_quantiles(real.unionByName(repeats), ["column"], "step", {"med": 0.5}, weight="w", few_keys=True).drop("n")
    med_distinct = grouped_quantiles(real, ["column"], "step", {"gap_med": 0.5}, few_keys=True).drop("n")
    gaps = real.join(med_distinct, "column").where(F.col("step") > 2.5 * F.col("gap_med")).groupBy("column").agg(
        F.count(F.lit(1)).alias("gap_count"), F.max(F.floor("step")).cast("bigint").alias("largest_gap_days"))
    span = steps.groupBy("column").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.sum("n").alias("n"))
    day = F.floor("med")
    freq = F.when(day <= 1, "daily").when(day <= 8, "weekly").when(day <= 32, "monthly").when(day <= 95, "quarterly").otherwise("yearly")
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    ago = F.floor((us(F.lit(as_of).cast("timestamp_ntz")) - us(F.col("max"))) / 8.64e10)
    return span.join(med_all, "column", "left").join(gaps, "column", "left").select(
        "column", "min", "max", F.floor((us(F.col("max")) - us(F.col("min"))) / 8.64e10).alias("range_days"),
        F.when(F.col("n") < 3, "unknown").otherwise(freq).alias("inferred_frequency"),
        F.coalesce("gap_count", F.lit(0)).alias("gap_count"), F.coalesce("largest_gap_days", F.lit(0)).alias("largest_gap_days"),
        ago.alias("most_recent_days_ago"),
        F.when(ago <= 7, "fresh").when(ago <= 30, "recent").when(ago <= 180, "stale").otherwise("outdated").alias("data_freshness"))


def time_gaps(df: DataFrame, col: str) -> DataFrame:
    """Steps between distinct dates above 2.5 times the median step."""
    steps = settle(_date_steps(_days(df, [col])).where("prev IS NOT NULL"))
    med = grouped_quantiles(steps, [], "step", {"med": 0.5}).select("med").scalar()
    return steps.withColumn("_m", med).where("step > 2.5 * _m").select(
        "column", F.col("prev").alias("gap_from"), F.col("value").alias("gap_to"), F.floor("step").alias("gap_days"))


def categorical_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Top values with counts, the rest's count, the mode and its share, mean word count of diverse columns."""
    cols = list(cols or text_columns(df))
    counts = category_counts(df, cols)
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    # The rank limit is applied by the map tasks, so a column with many values is never gathered.
    top = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= TOP_VALUES)
    tops = top.groupBy("column").agg(
        F.sum("n").alias("top_n"), F.max_by("value", -F.col("rank")).alias("most_common"), F.max("n").alias("mode_n"))
    sizes = counts.groupBy("column").agg(
        F.sum("n").alias("filled"), F.count(F.lit(1)).alias("unique"),
        F.sum(F.size(F.split(F.trim("value"), r"\s+")) * F.col("n")).alias("words"))
    rows = df.agg(F.count(F.lit(1))).scalar()
    return sizes.join(tops, "column").withColumn("rows", rows).select(
        "column", "unique", "most_common", F.round(F.col("mode_n") / F.col("rows") * 100, 1).alias("most_common_pct"),
        (F.col("filled") - F.col("top_n")).alias("other_count"),
        F.when(F.col("unique") / F.col("rows") > 0.3, F.round(F.col("words") / F.col("filled"), 1)).alias("avg_word_count"))


def top_values(df: DataFrame, cols: Sequence[str] | None = None, k: int = TOP_VALUES) -> DataFrame:
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return category_counts(df, list(cols or text_columns(df))).withColumn("rank", F.row_number().over(w)).where(
        F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))


def value_patterns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """First value pattern matched by at least half of a column's values, over all rows."""
    cols = list(cols or text_columns(df))
    r = wide_to_rows(df, cols, {
        "n": lambda c: F.count(c), **{name: (lambda c, rx=rx: F.count_if(F.col(c).rlike(rx))) for name, rx in VALUE_PATTERNS}})
    pct = lambda name: F.round(F.col(name) / F.col("n") * 100, 1)
    hits = F.filter(F.array(*[
        F.struct(F.lit(name).alias("pattern"), pct(name).alias("pct"), (F.col("n") - F.col(name)).alias("bad")) for name, _ in VALUE_PATTERNS
    ]), lambda s: s["pct"] >= PATTERN_MIN)
    return r.where("n > 0").withColumn("_h", F.try_element_at(hits, F.lit(1))).where("_h IS NOT NULL").select(
        "column", F.col("_h.pattern").alias("pattern"), F.when(F.col("_h.pct") >= PATTERN_STRONG, "strong").otherwise("weak").alias("strength"),
        F.col("_h.pct").alias("compliance_pct"), F.col("_h.bad").alias("malformed"))


def format_consistency(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Columns mixing date formats, or with three or more lengths of which the commonest covers under 70 %."""
    cols = list(cols or text_columns(df))
    shapes = wide_to_rows(df, cols, {
        "n": lambda c: F.count(c), **{f"s{i}": (lambda c, rx=rx: F.count_if(F.col(c).rlike(rx))) for i, (_, rx) in enumerate(DATE_SHAPES)}})
    found = sum(F.when(F.col(f"s{i}") > 0, 1).otherwise(0) for i in range(len(DATE_SHAPES)))
    lengths = stack_text(df, cols).where("value IS NOT NULL").groupBy("column", F.length("value").alias("len")).agg(
        F.count(F.lit(1)).alias("k")).groupBy("column").agg(F.count(F.lit(1)).alias("lengths"), F.max("k").alias("top"))
    issue = F.when(found >= 2, "mixed_date_formats").when(
        (F.col("lengths") >= 3) & (F.col("top") / F.col("n") < 0.7), "inconsistent_length")
    return shapes.where("n >= 10").join(lengths, "column").withColumn("issue", issue).where("issue IS NOT NULL").select(
        "column", "issue", "lengths", F.round(F.col("top") / F.col("n") * 100, 1).alias("top_length_pct"))


# Labels of binary columns whose name holds the word; all others are No / Yes.
BINARY_LABELS = [
    ("seniorcitizen", "Not senior", "Senior"), ("senior_citizen", "Not senior", "Senior"), ("senior", "Not senior", "Senior"),
    ("paperless", "Paper billing", "Paperless"),
]


def binary_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Numeric columns with exactly two values: both values, their counts and labels."""
    cols = list(cols or numeric_columns(df))
    r = wide_to_rows(df, cols, {
        "lo": lambda c: F.min(c).cast("double"), "hi": lambda c: F.max(c).cast("double"), "n": lambda c: F.count(c)})
    two = distinct_counts(df, cols).where("n_unique = 2").select("column")
    lows = stack_numbers(df, cols).where("value IS NOT NULL").join(F.broadcast(r.join(F.broadcast(two), "column").select("column", "lo")), "column").groupBy(
        "column").agg(F.count_if(F.col("value") == F.col("lo")).alias("low_count"))
    name = F.lower(F.regexp_replace("column", "[- ]", "_"))
    low, high = F.lit("No"), F.lit("Yes")
    for word, a, b in reversed(BINARY_LABELS):
        low, high = F.when(name.contains(word), a).otherwise(low), F.when(name.contains(word), b).otherwise(high)
    return r.join(lows, "column").select("column", F.col("lo").alias("low"), F.col("hi").alias("high"), "low_count",
                                         (F.col("n") - F.col("low_count")).alias("high_count"), low.alias("low_label"), high.alias("high_label"))


def full_profile(df: DataFrame, as_of: str = "2024-01-01") -> DataFrame:
    """One wide row per column: base, numeric, pattern and format results, as input of the rules below."""
    out = base_profile(df)
    nums, texts = numeric_columns(df), text_columns(df)
    if nums:
        n = numeric_profile(df, nums).select("column", "outliers_iqr", "skewness", "mean", "std", "min", "max", "dtype_confidence")
        out = out.join(F.broadcast(n), "column", "left").join(
            F.broadcast(normality_flags(df, nums).select("column", "is_normal")), "column", "left")
    else:
        out = out.withColumns({c: F.lit(None).cast("double") for c in ("skewness", "mean", "std", "min", "max")}).withColumns({
            "outliers_iqr": F.lit(None).cast("bigint"), "dtype_confidence": F.lit(None).cast("string"), "is_normal": F.lit(None).cast("boolean")})
    if texts:
        out = out.join(F.broadcast(value_patterns(df, texts).select("column", "pattern", "compliance_pct")), "column", "left").join(
            F.broadcast(format_consistency(df, texts).select("column", "issue")), "column", "left")
    else:
        out = out.withColumns({"pattern": F.lit(None).cast("string"), "compliance_pct": F.lit(None).cast("double"), "issue": F.lit(None).cast("string")})
    dates = date_columns(df)
    if dates:
        out = out.join(F.broadcast(datetime_profile(df, as_of, dates).select("column", "gap_count")), "column", "left")
    else:
        out = out.withColumn("gap_count", F.lit(None).cast("bigint"))
    return out


def quality_flags(profile: DataFrame) -> DataFrame:
    """Flag names per column, from a full profile."""
    num = F.col("type") == "numeric"
    flags = F.array_compact(F.array(
        F.when(F.col("missing_pct") > 30, "high missing data"), F.when(F.col("missing_pct") > 0, "missing"),
        F.when((F.col("unique_pct") > 95) & (F.col("type") == "categorical"), "possible ID column"),
        F.when(num & (F.col("outliers_iqr") > 0), "IQR outliers"), F.when(num & (F.abs("skewness") > 2), "highly skewed"),
        F.when(num & ~F.col("is_normal"), "non-normal distribution"), F.when(F.col("unique") == 1, "constant column"),
        F.when(F.col("compliance_pct") < 95, "malformed values"), F.when(F.col("issue").isNotNull(), "mixed formats detected"),
        F.when(F.col("gap_count") > 0, "time gaps detected")))
    return profile.select("column", F.concat_ws("; ", flags).alias("flags"), F.size(flags).cast("bigint").alias("n_flags"))
