"""Sampling operators (only where a sample is the wanted result)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hash_sample(df: DataFrame, row_id: str, fraction: float, seed: int = 42) -> DataFrame:
    """A repeatable uniform sample: rows whose hashed id falls below the fraction, independent of partitioning."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")))
    return df.where(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") < int(fraction * 2**32))


def latest_per_key(df: DataFrame, key: str, order: str, ties: str, n: int) -> DataFrame:
    """The latest ``n`` rows of every key; map tasks keep at most ``n`` rows per key before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.desc(order), ties)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
