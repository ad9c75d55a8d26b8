"""Ordered computations that never gather a whole group in one task.

A global or per-key order is cut into *blocks* by quantile edges of the order column. The edges are a bounded list of
numbers fetched once and then part of the plan, so every branch and every retry sees the same blocks. Work inside a
block is an ordinary window; what a block needs from the ones before it comes from a summary with one row per block.
A key that holds a third of all rows is therefore spread over about a third of the blocks. Blocks also carry a second
number: rows of one over-frequent order value are cut further by the tie-break column.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import shuffle_width

MAX_BLOCKS = 10_000
ROWS_PER_BLOCK = 100_000


def as_number(df: DataFrame, col: str) -> Column:
    """The order column as a double; dates and timestamps become microseconds."""
    kind = dict(df.dtypes)[col]
    c = F.col(col)
    if kind == "timestamp_ntz" or kind == "date":
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if kind == "timestamp":
        return F.unix_micros(c).cast("double")
    return c.cast("double")


def block_edges(df: DataFrame, number: Column, blocks: int | None = None) -> list[float]:
    """Quantile probes of an order column (repeats mark over-frequent values)."""
    n = min(blocks or shuffle_width(df.sparkSession), MAX_BLOCKS)
    if n < 2:
        return []
    probes = [i / n for i in range(1, n)]
    return df.select(number.alias("v")).approxQuantile("v", probes, 0.25 / n)


def _cut(df: DataFrame, number: Column, edges: Sequence[float], out: str) -> DataFrame:
    edges = [v for v in edges if math.isfinite(v)]  # infinite values fall into the outermost blocks
    splits = sorted(set(edges))
    frequent = [a for a, b in zip(edges, edges[1:]) if a == b]
    splits = sorted(set(splits) | {math.nextafter(v, math.inf) for v in frequent})
    df = df.withColumn("_num", number)
    if not splits:
        return df.withColumn(out, F.lit(0.0)).drop("_num")
    cutter = Bucketizer(
        splits=[-math.inf, *splits, math.inf], inputCol="_num", outputCol=out, handleInvalid="keep"
    )
    return cutter.transform(df).drop("_num")


def running_before(
    df: DataFrame, keys: Sequence[str], order: str, weight: str = "n", blocks: int | None = None,
    before: str = "before", total: str = "total", few_keys: bool = False,
) -> DataFrame:
    """Add the weight of all rows of the same keys with a smaller ``order`` value, and the key's total.

    ``order`` is unique within the keys (aggregate first), so one frequent value is one row. ``few_keys`` says that the
    keys are no data but names of columns or table sides: the block table is then small enough to broadcast.
    """
    number = as_number(df, order)
    cut = _cut(df, number, block_edges(df, number, blocks), "_blk")
    by_key = list(keys) or [F.lit(1)]
    inner = Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*by_key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by_key)
    offsets = cut.groupBy(*keys, "_blk").agg(F.sum(weight).alias("_w")).select(
        *keys, "_blk",
        F.coalesce(F.sum("_w").over(outer), F.lit(0)).alias("_off"),
        F.sum("_w").over(whole).alias(total),
    )
    return (
        cut.withColumn("_in", F.coalesce(F.sum(weight).over(inner), F.lit(0)))
        .join(F.broadcast(offsets) if few_keys or not keys else offsets, [*keys, "_blk"])
        .withColumn(before, F.col("_off") + F.col("_in"))
        .drop("_blk", "_in", "_off")
    )


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def grouped_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], weight: str | None = None,
    blocks: int | None = None, few_keys: bool = False,
) -> DataFrame:
    """Exact interpolated quantiles per key: ``keys``, one column per name in ``probs``, and the weight sum ``n``.

    A distributed selection: count rows per (key, block), find the blocks that hold the wanted ranks, and only order
    the rows of those blocks. Rows with a null key or value do not take part. ``weight`` names a count column,
    ``few_keys`` is as in ``running_before``.
    """
    keys = list(keys)
    rows = df.select(*keys, value, *([weight] if weight else [])).where(F.col(value).isNotNull())
    number = as_number(rows, value)
    cut = _cut(rows, number, block_edges(rows, number, blocks or max(64, shuffle_width(df.sparkSession))), "_blk")
    size = F.sum(weight) if weight else F.count(F.lit(1))
    by_key = keys or [F.lit(1)]
    outer = Window.partitionBy(*by_key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by_key)
    spans = cut.groupBy(*keys, "_blk").agg(size.alias("_w")).select(
        *keys, "_blk", "_w", F.coalesce(F.sum("_w").over(outer), F.lit(0)).alias("_off"),
        F.sum("_w").over(whole).alias("_n"),
    )

    def rank_pair(p):
        h = (F.col("_n") - 1) * F.lit(float(p))
        return h, F.floor(h), F.ceil(h)

    def holds(rank, start, length):
        return (F.col(start) <= rank) & (rank < F.col(start) + F.col(length))

    wanted = F.lit(False)
    for p in probs.values():
        _, lo, hi = rank_pair(p)
        wanted = wanted | holds(lo, "_off", "_w") | holds(hi, "_off", "_w")
    inner = Window.partitionBy(*keys, "_blk").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    hits = spans.where(wanted).drop("_w")
    if few_keys or not keys:
        # At most two blocks per probe and column: the rows of the other blocks are dropped where they are read.
        hits = F.broadcast(hits)
    placed = (
        cut.join(hits, [*keys, "_blk"])
        .groupBy(*keys, "_blk", value, "_off", "_n").agg(size.alias("_w"))
        .withColumn("_at", F.col("_off") + F.coalesce(F.sum("_w").over(inner), F.lit(0)))
    )
    picks = []
    for name, p in probs.items():
        h, lo, hi = rank_pair(p)
        v = F.col(value).cast("double")
        picks += [
            F.max(F.when(holds(lo, "_at", "_w"), v)).alias(f"_lo_{name}"),
            F.max(F.when(holds(hi, "_at", "_w"), v)).alias(f"_hi_{name}"),
            F.max(h - lo).alias(f"_fr_{name}"),
        ]
    return placed.groupBy(*keys).agg(*picks, F.max("_n").alias("n")).select(
        *keys,
        *[
            (F.col(f"_lo_{q}") + (F.col(f"_hi_{q}") - F.col(f"_lo_{q}")) * F.col(f"_fr_{q}")).alias(q)
            for q in probs
        ],
        "n",
    )


def average_ranks(counts: DataFrame, keys: Sequence[str], value: str, blocks: int | None = None) -> DataFrame:
    """Average rank of every distinct value from its counts (``keys, value, n`` in, plus ``rank`` and ``total``)."""
    placed = running_before(counts, keys, value, "n", blocks)
    return placed.withColumn("rank", F.col("before") + (F.col("n") + 1) / 2.0).drop("before")


def with_position(
    df: DataFrame, keys: Sequence[str], order: str, ties: str | None = None,
    descending: bool = False, pos: str = "pos", blocks: int | None = None,
) -> DataFrame:
    """Row number (from 1) within the keys by ``order`` then ``ties``, without one task per key."""
    sign = -1 if descending else 1
    number = as_number(df, order) * sign
    edges = block_edges(df, number, blocks)
    cut = _cut(df, number, edges, "_blk")
    frequent = sorted({a for a, b in zip(edges, edges[1:]) if a == b})
    if ties is not None and frequent:
        tie = as_number(df, ties)
        cut = _cut(cut, tie, block_edges(df, tie, blocks), "_sub")
        cut = cut.withColumn("_sub", F.when(number.isin(frequent), F.col("_sub")).otherwise(F.lit(0.0)))
    else:
        cut = cut.withColumn("_sub", F.lit(0.0))
    by_key = list(keys) or [F.lit(1)]
    direction = F.col(order).desc() if descending else F.col(order).asc()
    inner = Window.partitionBy(*keys, "_blk", "_sub").orderBy(direction, *([ties] if ties else []))
    outer = Window.partitionBy(*by_key).orderBy("_blk", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy(*keys, "_blk", "_sub").agg(F.count(F.lit(1)).alias("_w")).select(
        *keys, "_blk", "_sub", F.coalesce(F.sum("_w").over(outer), F.lit(0)).alias("_off")
    )
    return (
        cut.withColumn("_in", F.row_number().over(inner))
        .join(offsets if keys else F.broadcast(offsets), [*keys, "_blk", "_sub"])
        .withColumn(pos, (F.col("_off") + F.col("_in")).cast("bigint"))
        .drop("_blk", "_sub", "_in", "_off")
    )


def neighbourhood(
    df: DataFrame, keys: Sequence[str], build: Callable[[Callable[[int, int], object]], dict[str, Column]],
    before: int, after: int, pos: str = "pos", size: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Columns over row frames of bounded reach, by ``pos`` within the keys.

    Rows are cut into runs of ``size``; the last ``before`` rows of a run are copied to the next one and the first
    ``after`` rows to the previous one, so each run is complete on its own and one key spans many tasks.
    ``build(frame)`` gets a function ``frame(lo, hi)`` giving the window of rows lo..hi around the current one, or the
    plain ordered window for ``frame(None, None)`` (for ``lag``/``lead``).
    """
    size = max(size, before, after, 1)
    blk = F.floor((F.col(pos) - 1) / size)
    off = (F.col(pos) - 1) % size
    homes = F.array_compact(F.array(
        blk,
        F.when(off >= size - before, blk + 1),
        F.when((off < after) & (blk > 0), blk - 1),
    ))
    spread = df.withColumn("_run", F.explode(homes))
    base = Window.partitionBy(*keys, "_run").orderBy(pos)

    def frame(lo, hi):
        return base if lo is None else base.rowsBetween(lo, hi)

    return (
        spread.withColumns(build(frame))
        .where(F.col("_run") == blk)
        .drop("_run")
    )


def running(
    df: DataFrame, keys: Sequence[str], value: str, how: str, out: str, pos: str = "pos", size: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Cumulative ``max``, ``min``, ``sum`` or last non-null value (``last``) up to and including each row."""
    blk = F.floor((F.col(pos) - 1) / size)
    fns = {"max": F.max, "min": F.min, "sum": F.sum, "last": lambda c: F.last(c, ignorenulls=True)}
    fn = fns[how]
    cut = df.withColumn("_run", blk)
    inner = Window.partitionBy(*keys, "_run").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    by_key = list(keys) or [F.lit(1)]
    outer = Window.partitionBy(*by_key).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    summary = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(pos))) if how == "last" else fn(value)
    blocks = cut.groupBy(*keys, "_run").agg(summary.alias("_s")).select(
        *keys, "_run", fn("_s").over(outer).alias("_before")
    )
    here, prev = F.col("a._here"), F.col("b._before")
    joined = {
        "max": F.greatest(here, prev), "min": F.least(here, prev),
        "sum": F.coalesce(here, F.lit(0)) + F.coalesce(prev, F.lit(0)), "last": F.coalesce(here, prev),
    }[how]
    cond = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.col("a._run") == F.col("b._run")]
    return (
        cut.withColumn("_here", fn(value).over(inner)).alias("a")
        .join(blocks.alias("b"), cond)
        .select(*[F.col(f"a.{c}") for c in df.columns], joined.alias(out))
    )


def with_previous(df: DataFrame, keys: Sequence[str], order: str, take: str | None = None, out: str = "prev") -> DataFrame:
    """Add ``pos`` and the value of ``take`` (the order column by default) on the row before, within the keys."""
    placed = with_position(df, keys, order)
    return neighbourhood(
        placed, keys, lambda frame: {out: F.lag(take or order).over(frame(None, None))}, before=1, after=0
    )
