"""Comparison of two tables and of two runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.plans.ordered import grouped_quantiles
from gridloom.plans.stacked import numeric_columns, stack_numbers

BINS = 11


def _side(df: DataFrame, cols: Sequence[str], tag: str) -> DataFrame:
    return stack_numbers(df, cols).where(F.col("value").isNotNull()).withColumn("side", F.lit(tag))


def compare_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean, std and median of both sides and the change flag for all shared numeric columns."""
    cols = sorted(set(numeric_columns(a)) & set(numeric_columns(b)))
    both = _side(a, cols, "a").unionByName(_side(b, cols, "b"))
    moments = both.groupBy("column", "side").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    medians = grouped_quantiles(both, ["column", "side"], "value", {"median": 0.5}, few_keys=True).drop("n")
    rows = moments.join(medians, ["column", "side"])
    wide = rows.groupBy("column").pivot("side", ["a", "b"]).agg(
        F.first("mean").alias("mean"), F.first("std").alias("std"), F.first("median").alias("median")
    )
    pct = F.when(F.col("a_mean") != 0, F.round((F.col("b_mean") - F.col("a_mean")) / F.abs("a_mean") * 100, 2))
    return wide.select(
        "column", *[F.round(f"{s}_{m}", 4).alias(f"{s}_{m}") for s in "ab" for m in ("mean", "std", "median")],
        pct.alias("mean_diff_pct"),
    ).withColumn("change_flag", change_flag(F.col("mean_diff_pct")))


def change_flag(pct: Column) -> Column:
    return (
        F.when(pct.isNull(), "no_data").when(F.abs(pct) > 20, "significant")
        .when(F.abs(pct) >= 5, "notable").otherwise("stable")
    )


def aligned_histograms(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Counts of both sides in 11 equal bins over the combined range, per column."""
    both = _side(a, cols, "a").unionByName(_side(b, cols, "b"))
    span = both.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / BINS
    at = F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(BINS - 1)) + 1
    counted = both.join(F.broadcast(span), "column").where(F.col("hi") > F.col("lo")).groupBy(
        "column", at.cast("bigint").alias("bin"), "lo", "hi"
    ).agg(F.count_if(F.col("side") == "a").alias("a_count"), F.count_if(F.col("side") == "b").alias("b_count"))
    return counted.select("column", "bin", "a_count", "b_count")


def caution_flags(volume: DataFrame, deltas: DataFrame, schema: DataFrame, health: DataFrame) -> DataFrame:
    """Cautions of a comparison in order of severity.

    ``volume(count_a, count_b, overlap_pct)``, ``deltas(column, mean_diff_pct, change_flag)``, ``schema(column, side)``
    and ``health(score_a, score_b)`` are the other comparison results.
    """
    def flag(d, kind, severity, column=None):
        return d.select(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"),
                        (F.col(column) if column else F.lit(None).cast("string")).alias("column"))
    diff = (F.col("count_b") - F.col("count_a")) / F.col("count_a") * 100
    once = lambda d: d.limit(1)
    parts = [
        flag(once(schema.where("side = 'only_a'")), "columns_removed", "high"),
        flag(once(schema.where("side = 'only_b'")), "columns_added", "low"),
        flag(volume.where(diff < -20), "large_volume_drop", "high"),
        flag(volume.where(diff > 50), "large_volume_spike", "medium"),
        flag(deltas.where("change_flag = 'significant'"), "significant_metric_shift", "medium", "column"),
        flag(health.where("score_b - score_a < -5"), "health_declined", "high"),
        flag(volume.where("overlap_pct > 90"), "high_row_overlap", "medium"),
        flag(volume.where("overlap_pct < 10"), "low_row_overlap", "medium"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return out.withColumn("rank", rank.cast("bigint")).orderBy("rank", "kind", "column")


def metric_deltas(a: DataFrame, b: DataFrame) -> DataFrame:
    """Named metrics of two runs side by side with the change and its direction."""
    j = a.withColumnRenamed("value", "a").join(b.withColumnRenamed("value", "b"), "name", "full_outer")
    delta = F.round(F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0)), 2)
    return j.select("name", "a", "b", delta.alias("delta")).withColumn(
        "direction", F.when(F.col("delta") > 0, "up").when(F.col("delta") < 0, "down").otherwise("unchanged")
    )
