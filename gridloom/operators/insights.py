"""One findings table from all detectors over one table, in the shape that ranking, penalties and selection take."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators import detectors as det
from gridloom.operators.aggregates import category_counts, concentration
from gridloom.operators.correlation import correlation_findings
from gridloom.operators.filters import distinct_counts
from gridloom.operators.isolation import anomaly_summary, isolation_forest
from gridloom.plans.stacked import date_columns, numeric_columns, text_columns, wide_to_rows
from gridloom.session import settle

FIELDS = ["type", "severity", "confidence", "title", "columns", "is_target_driver"]
MAX_LEVELS, ID_SHARE = 50, 0.95


def _finding(rows: DataFrame, stage: int, kind: str, severity, confidence, title: Column, columns: Sequence[str | Column], driver=False) -> DataFrame:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return rows.select(F.lit(stage).alias("_stage"), F.lit(kind).alias("type"), lit(severity).alias("severity"), lit(confidence).cast("double").alias("confidence"),
                       title.alias("title"), F.array(*columns).cast("array<string>").alias("columns"), lit(driver).alias("is_target_driver"))


def column_sets(df: DataFrame, row_id: str | None = None) -> tuple[list[str], list[str]]:
    """Numbers and categories that take part: without id columns (name holds "id", over 95 % distinct); categories have
    under 50 values, numbers with two values count as categories too and come first."""
    cols = [c for c in df.columns if c != row_id]
    n = df.count()
    k = {r["column"]: r["n_unique"] for r in distinct_counts(df, cols).collect()}
    use = [c for c in cols if not ("id" in c.lower() and k.get(c, 0) / max(n, 1) > ID_SHARE)]
    nums = [c for c in use if c in numeric_columns(df)]
    cats = [c for c in nums if k.get(c, 0) == 2] + [c for c in use if c in text_columns(df) and k.get(c, 0) < MAX_LEVELS]
    return nums, cats


def _concentration(df: DataFrame, nums: Sequence[str], cats: Sequence[str]) -> list[DataFrame]:
    out = []
    if nums:
        low = wide_to_rows(df, nums, {"low": lambda c: F.min(c).cast("double")})
        share = F.col("top10_share") * 100
        rows = concentration(df, nums).join(F.broadcast(low), "column").where((F.col("n") >= 20) & (F.col("low") >= 0) & (share > 50))
        out.append(_finding(rows, 10, "concentration", F.when(share > 70, "high").otherwise("medium"), F.round(F.least(F.lit(95.0), 60 + share * 0.4), 1),
                            F.concat(F.lit("Concentration risk in "), "column"), ["column"]))
    if cats:
        top = category_counts(df, cats).groupBy("column").agg(F.count(F.lit(1)).alias("levels"), F.max("n").alias("top_n"))
        rows = top.withColumn("_n", df.agg(F.count(F.lit(1))).scalar()).where("levels >= 2 AND top_n > 0.7 * _n")
        out.append(_finding(rows, 11, "concentration", "medium", 90.0, F.concat(F.lit("Category dominance: "), "column"), ["column"]))
    return out


def collect_findings(df: DataFrame, row_id: str, time: str | None = None, run_id: int | str = 0, nums: Sequence[str] | None = None, cats: Sequence[str] | None = None) -> DataFrame:
    """Findings of all detectors: ``run_id, seq, type, severity, confidence, title, columns, is_target_driver, domain``.

    All numbers and categories of ``column_sets`` take part unless named. Trends and leading indicators need a ``time``
    column (the first date column by default). ``seq`` counts in the order of the detectors, then by title: one row per
    column or pair of columns, so the last numbering is small whatever the table holds. An empty table has no findings.
    """
    df = settle(df)
    if nums is None or cats is None:
        found = column_sets(df, row_id)
        nums, cats = list(found[0] if nums is None else nums), list(found[1] if cats is None else cats)
    time = time or next(iter(date_columns(df)), None)
    grouped = df.select("*", *[F.col(c).cast("string").alias(c + "#level") for c in cats])
    named = lambda c: F.regexp_replace(c, "#level$", "")
    levels = [c + "#level" for c in cats]
    parts: list[DataFrame] = []
    if len(nums) >= 2:
        parts.append(_finding(correlation_findings(df, nums), 1, "correlation", F.col("severity"), F.col("confidence"),
                              F.concat(F.lit("Relationship detected: "), "col_a", F.lit(" & "), "col_b"), ["col_a", "col_b"]))
        s = anomaly_summary(isolation_forest(df, row_id, nums)).where("anomalies > 0")
        parts.append(_finding(s, 2, "anomaly", F.col("severity"), F.round(F.least(F.lit(95.0), 70 + F.col("anomaly_pct") * 2), 1),
                              F.format_string("Multivariate anomalies detected (%d rows)", "anomalies"), [F.lit(c) for c in nums]))
    if nums:
        parts.append(_finding(det.univariate_anomalies(df, nums), 3, "anomaly", F.col("severity"), F.col("confidence"), F.concat(F.lit("Anomalies in "), "column"), ["column"]))
        parts.append(_finding(det.skewness_findings(df, nums), 4, "distribution", "medium", F.col("confidence"), F.concat(F.lit("Skewed distribution: "), "column"), ["column"]))
    if nums and cats:
        gaps = det.segment_gaps(grouped, levels, nums).withColumn("cat_col", named("cat_col")).where("cat_col <> num_col")
        parts.append(_finding(gaps, 5, "segment", F.col("severity"), F.col("confidence"), F.concat(F.lit("Segment gap: "), "cat_col", F.lit(" → "), "num_col"), ["cat_col", "num_col"]))
    if len(cats) >= 2:
        rates = det.binary_rate_gaps(grouped, None, levels)
        if "severity" in rates.columns:
            rates = rates.withColumns({c: named(c) for c in ("target", "cat_col")})
            driver = F.col("target").isin([c for c in cats if det.is_outcome(c)])
            parts.append(_finding(rates, 6, "segment", F.col("severity"), F.col("confidence"), F.concat(F.lit("Rate gap: "), "cat_col", F.lit(" → "), "target"), ["cat_col", "target"], driver))
    label = F.element_at(F.create_map(*[F.lit(x) for x in ("high_cardinality", "High-cardinality column: ", "missing", "Missing data in ", "constant", "Constant column: ")]), F.col("kind"))
    order = {"high_cardinality": 7, "missing": 8, "constant": 9}
    quality = det.quality_findings(df.drop(row_id))
    parts += [_finding(quality.where(F.col("kind") == k), i, "data_quality", F.col("severity"), F.col("confidence"), F.concat(label, "column"), ["column"]) for k, i in order.items()]
    parts += _concentration(df, nums, cats)
    if len(nums) >= 2 and cats:
        moderated = settle(det.moderated_correlations(grouped, nums, levels).withColumn("moderator", named("moderator")))
        inter, flips = det.interaction_effects(moderated), det.simpsons_paradox(moderated)
        parts.append(_finding(inter, 12, "interaction", F.col("severity"), F.col("confidence"),
                              F.concat(F.lit("Interaction effect: "), "col_a", F.lit(" × "), "col_b", F.lit(" moderated by "), "moderator"), ["col_a", "col_b", "moderator"]))
        parts.append(_finding(flips, 13, "simpsons_paradox", "high", 80.0,
                              F.concat(F.lit("Possible Simpson's Paradox: "), "col_a", F.lit(" vs "), "col_b", F.lit(" by "), "moderator"), ["col_a", "col_b", "moderator"]))
    if nums:
        parts.append(_finding(det.missing_patterns(df.drop(row_id), nums), 14, "missing_pattern", "medium", F.round(F.abs("r") * 100, 1),
                              F.concat(F.lit("Structural missing data: "), "missing_column", F.lit(" linked to "), "column"), ["missing_column", "column"]))
    if time and len(nums) >= 2:
        lead = det.leading_indicators(df, time, row_id, nums)
        parts.append(_finding(lead, 15, "leading_indicator", "medium", F.round(F.abs("r") * 100, 1),
                              F.concat(F.lit("Leading indicator: "), "col_a", F.lit(" → "), "col_b", F.lit(" (lag "), F.col("lag").cast("string"), F.lit(")")), ["col_a", "col_b"]))
    if len(nums) >= 3:
        high = det.vif(df, nums).where("vif > 5").agg(F.count(F.lit(1)).alias("k"), F.bool_or(F.col("severity") == "high").alias("severe"), F.array_sort(F.collect_list("column")).alias("cols")).where("k > 0")
        parts.append(high.select(F.lit(16).alias("_stage"), F.lit("multicollinearity").alias("type"), F.when(F.col("severe"), "high").otherwise("medium").alias("severity"),
                                 F.round(F.least(F.lit(95.0), 70 + F.col("k") * 5.0), 1).alias("confidence"), F.format_string("Multicollinearity detected (%d columns)", "k").alias("title"),
                                 F.col("cols").alias("columns"), F.lit(False).alias("is_target_driver")))
    if time and nums:
        trend = det.trend_findings(df, time, nums)
        parts.append(_finding(trend, 17, "trend", F.col("severity"), F.col("confidence"),
                              F.concat(F.lit("Trend detected: "), "column", F.lit(" ("), "direction", F.lit(")")), ["column", F.lit(time)]))
    found = reduce(lambda a, b: a.unionByName(b), parts)
    w = Window.partitionBy("run_id").orderBy("_stage", "title")
    return settle(found.withColumn("run_id", F.lit(run_id)).withColumn("seq", F.row_number().over(w).cast("bigint")).select(
        "run_id", "seq", *FIELDS, F.lit(None).cast("string").alias("domain")))
