"""Session defaults shared by the bench, the tests and the examples."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(cores: str = "8", app: str = "gridloom") -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("GRIDLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, setting a temporary one only in local mode and where none is named.

    A cluster names a shared folder in ``spark.checkpoint.dir``: executors don't share a temporary one, so it is refused there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if named:
        if current is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if current is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="gridloom-ckpt-")
        spark.sparkContext.setCheckpointDir(current)
    return current


def shuffle_width(spark: SparkSession) -> int:
    """Number of shuffle partitions the session is configured for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def settle(df: DataFrame) -> DataFrame:
    """Compute a derived table once and keep it in the checkpoint folder, for plans that read it several times."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
