"""Outlier exploration of one numeric column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.moments import skew_g1
from gridloom.plans.ordered import grouped_quantiles

WORST_ROWS = 100


def outlier_stats(df: DataFrame, col: str) -> DataFrame:
    """One row: moments, quartiles, adaptive thresholds and fences."""
    v = df.select(F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull())
    q = grouped_quantiles(v, [], "v", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    m = v.agg(F.count("v").alias("total_rows"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
              F.stddev_pop("v").alias("sd_pop"), F.min("v").alias("min"), F.max("v").alias("max"), skew_g1("v").alias("skewness"))
    out = m.select("*", q.select(F.struct("q1", "median", "q3")).scalar().alias("q")).select("*", "q.*").drop("q")
    skewed = F.abs("skewness") > 1
    iqr = F.col("q3") - F.col("q1")
    mult = F.when(skewed, 3.0).otherwise(1.5)
    return out.withColumns({
        "adaptive": skewed, "z_threshold": F.when(skewed, 3.5).otherwise(3.0), "iqr_multiplier": mult,
        "lower_fence": F.col("q1") - mult * iqr, "upper_fence": F.col("q3") + mult * iqr,
    })


def flag_outliers(df: DataFrame, col: str, stats: DataFrame) -> DataFrame:
    """All non-null rows with the z-score, IQR and combined flags."""
    one = stats.select(F.struct("mean", "sd_pop", "z_threshold", "lower_fence", "upper_fence")).scalar()
    v = F.col(col).cast("double")
    d = df.where(F.col(col).isNotNull()).withColumn("_s", one)
    z = F.try_divide(v - F.col("_s.mean"), F.col("_s.sd_pop"))
    return d.withColumn("z_score", z).withColumn("zscore_flag", F.coalesce(F.abs(z) > F.col("_s.z_threshold"), F.lit(False))).withColumn(
        "iqr_flag", (v < F.col("_s.lower_fence")) | (v > F.col("_s.upper_fence"))
    ).withColumn("combined_flag", F.col("zscore_flag") | F.col("iqr_flag")).withColumn(
        "pct_deviation", F.when(F.col("_s.mean") != 0, F.round((v - F.col("_s.mean")) / F.col("_s.mean") * 100, 1))
    ).drop("_s")


def method_counts(df: DataFrame, col: str) -> DataFrame:
    """Counts and shares per method beside the thresholds."""
    stats = outlier_stats(df, col)
    f = flag_outliers(df.select(col), col, stats).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("zscore_flag").alias("zscore"), F.count_if("iqr_flag").alias("iqr"),
        F.count_if("combined_flag").alias("combined"))
    s = stats.select(F.struct("skewness", "z_threshold", "iqr_multiplier", "lower_fence", "upper_fence", "median")).scalar()
    pct = lambda c: F.round(F.col(c) / F.col("total") * 100, 2).alias(f"{c}_pct")
    return f.withColumn("_s", s).select(
        "total", "zscore", "iqr", "combined", pct("zscore"), pct("iqr"), pct("combined"), F.round("_s.skewness", 3).alias("skewness"),
        "_s.z_threshold", "_s.iqr_multiplier", F.round("_s.lower_fence", 4).alias("lower_fence"),
        F.round("_s.upper_fence", 4).alias("upper_fence"), F.round("_s.median", 4).alias("median"))


def worst_rows(df: DataFrame, row_id: str, col: str, n: int = WORST_ROWS) -> DataFrame:
    """The flagged rows with the largest |z| (a top-k report)."""
    flags = flag_outliers(df.select(row_id, col), col, outlier_stats(df, col))
    return flags.where("combined_flag").orderBy(F.desc(F.abs(F.col("z_score"))), row_id).limit(n).select(
        row_id, F.round(col, 4).alias("value"), F.round("z_score", 3).alias("z_score"), "zscore_flag", "iqr_flag", "pct_deviation")


def outlier_histogram(df: DataFrame, col: str) -> DataFrame:
    """8 to 20 equal bins with share, cumulative share and the flag of bins centred outside the fences."""
    stats = outlier_stats(df, col)
    s = stats.select(F.struct("min", "max", "lower_fence", "upper_fence", "total_rows")).scalar()
    v = df.select(F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull()).withColumn("_s", s)
    bins = F.least(F.lit(20), F.greatest(F.lit(8), F.floor(F.col("_s.total_rows") / 20)))
    width = (F.col("_s.max") - F.col("_s.min")) / bins
    at = F.least(F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("_s.min"), width)), F.lit(0)), bins - 1)
    h = v.groupBy(at.cast("bigint").alias("bin"), "_s").agg(F.count(F.lit(1)).alias("value"))
    centre = F.col("_s.min") + (F.col("bin") + 0.5) * width
    from pyspark.sql import Window
    upto = Window.partitionBy("_s").orderBy("bin")
    return h.select(
        "bin", "value", F.round(F.col("value") / F.col("_s.total_rows"), 4).alias("density"),
        F.round(F.sum("value").over(upto) / F.col("_s.total_rows") * 100, 1).alias("cumulative_pct"),
        ((centre < F.col("_s.lower_fence")) | (centre > F.col("_s.upper_fence"))).alias("is_outlier_bin"))
