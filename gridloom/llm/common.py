"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACED_WORD = r"[^\x20\x09-\x0D]+"
#: Rows of texts handed to one Python call; texts may be long, so batches are also cut by bytes.
PIECE_BYTES = 4 << 20


def pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one piece holds about ``PIECE_BYTES`` of ``column``; one longer text is a piece alone."""
    for batch in batches:
        sizes = text_sizes(batch.column(column))
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and held + n > PIECE_BYTES:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if batch.num_rows > start:
            yield batch.slice(start)


def text_sizes(texts: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.binary_length(texts), 0))


def byte_texts(texts: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of every text."""
    kind = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    return texts.cast(kind).to_pylist()


def add_columns(df: DataFrame, text: str, fields: list[T.StructField], fn: Callable[[list], list]) -> DataFrame:
    """``df`` with the columns that ``fn`` derives from the texts of a piece; a column of the same name is replaced.

    Every other column, of any type, passes through as Arrow data. ``fn`` gets a list of UTF-8 texts (or None) and returns one
    list or array for each field.
    """
    names = [f.name for f in fields]
    base = df.drop(*[n for n in names if n != text])
    schema = T.StructType([*base.schema.fields, *fields])
    kinds = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kinds)
        for piece in pieces(batches, text):
            made = fn(byte_texts(piece.column(text)))
            yield pa.RecordBatch.from_arrays([*piece.columns, *(pa.array(v, type=f.type) for v, f in zip(made, arrow))], names=[*piece.schema.names, *names])

    return base.mapInArrow(run, schema)


def unit_hash(*cols: Column) -> Column:
    """A number in [0, 1) decided by the values alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def running_start(grouped: DataFrame, part: str, block: str, order: list[Column], weight: Column, name: str) -> DataFrame:
    """Add ``name``: the summed ``weight`` of all rows of ``part`` that come before, in order of (block, order).

    No window spans a whole part: rows are summed within (part, block), and each block starts at the sum of the blocks before
    it, taken from a summary with one row per (part, block). ``grouped`` is read twice, so it should be settled.
    """
    before = Window.partitionBy(part).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    blocks = grouped.groupBy(part, block).agg(F.sum(weight).alias("__words")).withColumn("__offset", F.coalesce(F.sum("__words").over(before), F.lit(0)))
    offsets = blocks.select(F.col(part).alias("__part"), F.col(block).alias("__block"), "__offset")
    inside = Window.partitionBy("__part", "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = grouped.join(offsets, F.col(part).eqNullSafe(F.col("__part")) & (F.col(block) == F.col("__block")))
    return joined.withColumn(name, F.col("__offset") + F.coalesce(F.sum(weight).over(inside), F.lit(0))).drop("__part", "__block", "__offset")
