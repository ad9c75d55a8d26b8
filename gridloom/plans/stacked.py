"""Wide-to-long shapes: many columns share one shuffle instead of one job per column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in NUMERIC or t.startswith("decimal")]


def text_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t == "string"]


def date_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in ("timestamp", "timestamp_ntz", "date")]


def clean_number(c: str | Column) -> Column:
    """A double with NaN turned into null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(c.cast("double"), F.lit(float("nan")))


def stack_numbers(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``keep…, column, value`` with one row per numeric cell."""
    return df.select(*keep, *[clean_number(c).alias(c) for c in cols]).unpivot(
        list(keep), list(cols), "column", "value"
    )


def stack_text(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``keep…, column, value`` with one row per cell, values as text."""
    return df.select(*keep, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        list(keep), list(cols), "column", "value"
    )


def wide_to_rows(df: DataFrame, cols: Sequence[str], measures: dict[str, callable]) -> DataFrame:
    """One aggregate pass over all columns, returned as one row per column.

    ``measures`` maps an output name to a function from the column name to an aggregate expression.
    """
    packed = df.agg(*[
        F.struct(F.lit(c).alias("column"), *[fn(c).alias(name) for name, fn in measures.items()]).alias(f"_{i}")
        for i, c in enumerate(cols)
    ])
    return packed.select(F.inline(F.array(*[f"_{i}" for i in range(len(cols))])))
