"""Exact nearest rows in a metric space: cells around pivots, visited only where a bound says that a partner may lie there.

Vectors are array<double> of one width. A null component is unknown: distances run over the components that both rows know,
scaled up by the square root of width / known. Rows with the same unknown components form a pattern, and cells never mix
patterns, so the triangle inequality holds between a cell and any seeker over the components they share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.session import settle

#: Pivots and patterns that the driver holds and broadcasts (of a few numbers each); donors and seekers that meet in one piece.
PIVOTS, PATTERNS, PIECE = 2048, 1024, 2048
#: Relative error that bounds allow for products of whole matrices; distances that decide a result are never taken from those.
SLACK = 1e-6


def matrix(vectors: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of an array column; unknown components are NaN."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(len(vectors), width)


def squared_gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Summed squared differences over known components, component by component, so that small distances keep all digits."""
    out = np.zeros((len(a), len(b)))
    for x, y in zip(a.T, b.T):
        d = x[:, None] - y[None, :]
        np.nan_to_num(d, copy=False, nan=0.0, posinf=np.inf, neginf=np.inf)
        out += d * d
    return out


def rough_gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances for choosing and bounding cells, by one matrix product where nothing is unknown."""
    if np.isnan(a).any() or np.isnan(b).any():
        return np.sqrt(squared_gaps(a, b))
    return np.sqrt(np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)))


def shared_components(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (~np.isnan(a)).astype(np.float64) @ (~np.isnan(b)).astype(np.float64).T


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``a`` from all of ``b``; infinite where they share no component."""
    if not np.isnan(a).any() and not np.isnan(b).any():
        return np.sqrt(squared_gaps(a, b))
    shared = shared_components(a, b)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(shared > 0, np.sqrt(squared_gaps(a, b) * (a.shape[1] / shared)), np.inf)


@dataclass
class Cells:
    """What every task knows: pivots, how far each cell reaches, its rows, and the pivots' own distances."""

    pivots: np.ndarray
    reach: np.ndarray
    rows: np.ndarray
    open_rows: int = 0  # rows of rare patterns: cells without a pivot that everyone visits
    blocks: np.ndarray | None = None  # blocks of every cell, the open one last
    between: np.ndarray | None = None  # made where it is used

    @property
    def width(self) -> int:
        return self.pivots.shape[1]

    def homes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest pivot of the same pattern (the open cell if there is none) and the unscaled distance from it."""
        known_x, known_p = ~np.isnan(x), ~np.isnan(self.pivots)
        alike = (known_x.astype(np.float64) @ known_p.T + (~known_x).astype(np.float64) @ (~known_p).T) > self.width - 0.5
        if not len(self.pivots) or not len(x):
            return np.full(len(x), len(self.pivots)), np.zeros(len(x))
        gaps = np.where(alike, rough_gaps(x, self.pivots), np.inf)
        at = gaps.argmin(axis=1)
        far = np.sqrt(np.nansum((x - self.pivots[at]) ** 2, axis=1))
        none = ~alike.any(axis=1)
        return np.where(none, len(self.pivots), at), np.where(none, 0.0, far)

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """No row of a cell is nearer than its bound. Second: the order in which cells are worth a visit (the first is home).

        By the triangle inequality a cell is at least the pivot's distance less the cell's reach away; where nothing is unknown,
        also the distance from the plane that parts its pivot from the seeker's nearest one.
        """
        shared = shared_components(x, self.pivots)
        gaps = rough_gaps(x, self.pivots)
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(shared > 0, np.sqrt(self.width / shared), np.inf)
            low = np.where(shared > 0, np.maximum(0.0, gaps - self.reach) * scale, np.inf)
            worth = np.where(shared > 0, gaps * scale, np.inf)
        if not np.isnan(x).any() and not np.isnan(self.pivots).any() and len(self.pivots) > 1:
            home = gaps.argmin(axis=1)
            if self.between is None:
                self.between = rough_gaps(self.pivots, self.pivots)
            between = self.between[home]
            near = gaps[np.arange(len(x)), home][:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = (gaps**2 - near**2) / (2 * between)
            low = np.maximum(low, np.where(between > 0, plane, 0.0))
        # Rounding must not hide a partner.
        size = np.sqrt(np.nansum(x * x, axis=1))[:, None] + (np.sqrt(np.nansum(self.pivots**2, axis=1)).max() if len(self.pivots) else 0.0)
        low = np.maximum(0.0, low * (1 - SLACK) - SLACK * size)
        none = np.full((len(x), 1), 0.0 if self.open_rows else np.inf)
        return np.hstack([low, none]), np.hstack([worth, np.full((len(x), 1), 1e300 if self.open_rows else np.inf)])


def _pattern(vec: Column) -> Column:
    return F.array_join(F.transform(vec, lambda v: F.when(v.isNull(), "0").otherwise("1")), "")


def settle_cells(donors: DataFrame, width: int, members: int = 0) -> tuple[Cells, DataFrame]:
    """Cells over ``donors`` (with vec) and the donors themselves, settled, with cell and block.

    Pivots are drawn by a hash of the vectors, in each pattern by its share, so dense regions have many and a cell holds
    about the root of all rows (at least ``members``), wherever the rows crowd. Equal vectors should be one donor.
    """
    spark = donors.sparkSession
    donors = settle(donors.withColumn("pattern", _pattern(F.col("vec"))))
    sizes = donors.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "pattern").limit(PATTERNS).collect()
    n = sum(r["n"] for r in sizes)
    wanted = min(PIVOTS, ceil(min(sqrt(n), n / max(1, members)))) if n else 0
    quota = {r["pattern"]: max(1, round(wanted * r["n"] / n)) for r in sizes}
    pivots = np.zeros((0, width))
    if quota:
        shares = F.broadcast(spark.createDataFrame(list(quota.items()), "pattern string, quota int"))
        order = Window.partitionBy("pattern").orderBy(F.xxhash64("vec"), "vec")
        drawn = donors.join(shares, "pattern").select("pattern", "vec", "quota", F.row_number().over(order).alias("k")).where(F.col("k") <= max(quota.values())).where("k <= quota")
        pivots = np.array([[np.nan if v is None else v for v in r["vec"]] for r in drawn.orderBy("pattern", "k").collect()], np.float64).reshape(-1, width)
    bare = spark.sparkContext.broadcast(Cells(pivots, np.zeros(len(pivots)), np.zeros(len(pivots))))
    schema = T.StructType([*donors.drop("pattern", "cell", "gap").schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("gap", T.DoubleType())])
    names = [f.name for f in schema]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in stripes(batch.num_rows, 512):
                part = batch.slice(s.start, s.stop - s.start)
                cell, gap = bare.value.homes(matrix(part.column("vec"), width))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.array(gap)], names=names)

    placed = settle(donors.drop("pattern", "cell", "gap").mapInArrow(place, schema))
    facts = placed.groupBy("cell").agg(F.max("gap").alias("reach"), F.count(F.lit(1)).alias("n")).collect()
    cells = Cells(pivots, np.zeros(len(pivots)), np.zeros(len(pivots)))
    for r in facts:
        if r["cell"] == len(pivots):
            cells = replace(cells, open_rows=r["n"])
        else:
            cells.reach[r["cell"]], cells.rows[r["cell"]] = r["reach"], r["n"]
    cells.blocks = np.maximum(1, np.ceil(np.append(cells.rows, cells.open_rows) / PIECE)).astype(np.int64)
    blocks = F.broadcast(spark.createDataFrame([(i, int(b)) for i, b in enumerate(cells.blocks)], "cell int, blocks int"))
    return cells, placed.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("vec", F.lit(1)), "blocks").cast("int")).drop("gap", "blocks")


def meet(seekers: DataFrame, cells: Cells, donors: DataFrame, home: bool, found: Callable[[pa.Table, pa.Table], pa.Table], schema: str, seed: str, asks: int | None = None) -> DataFrame:
    """Bring seekers (with vec and reach) and the donors of cells together, piece by piece, through ``found``.

    ``home``: each seeker visits only the cell most worth it; else all others whose bound is within its reach (null: all).
    A piece is a block of donors and a share of the seekers that visit it, so no cell, however full or asked for, is one
    task. ``seed`` names the column by which seekers are dealt into shares (of PIECE rows, or ``asks``).
    """
    spark, width = seekers.sparkSession, cells.width
    shared = spark.sparkContext.broadcast(cells)
    fields = [f for f in seekers.schema.fields if f.name not in ("cell", "block")]
    out = T.StructType([*fields, T.StructField("cell", T.IntegerType()), T.StructField("block", T.IntegerType())])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, blocks = shared.value, shared.value.blocks
        for whole in batches:
            for s in stripes(whole.num_rows, 512):
                batch = whole.slice(s.start, s.stop - s.start)
                x = matrix(batch.column("vec"), width)
                reach = np.asarray(batch.column("reach").to_numpy(zero_copy_only=False), np.float64)
                reach = np.where(np.isnan(reach), np.inf, reach)
                low, worth = known.bounds(x)
                first = worth.argmin(axis=1)
                goes = np.zeros(low.shape, bool)
                if home:
                    goes[np.arange(len(x)), first] = True
                else:
                    goes = low <= reach[:, None]
                    goes[np.arange(len(x)), first] = False
                goes &= np.isfinite(worth)
                who, cell = np.nonzero(goes)
                times = blocks[cell]
                who, cell_of = np.repeat(who, times), np.repeat(cell, times)
                block = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
                rows = batch.take(pa.array(who))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cell_of, pa.int32()), pa.array(block, pa.int32())], names=[f.name for f in out])

    visits = seekers.select(*[f.name for f in fields]).mapInArrow(visit, out)
    asked = visits.where("block = 0").groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (asks or PIECE)).cast("int").alias("shares")).where("shares > 1").collect()
    shares = F.broadcast(spark.createDataFrame([tuple(r) for r in asked], "cell int, shares int"))
    mine = visits.join(shares, "cell", "left").withColumn("share", F.pmod(F.xxhash64(seed, F.lit(7)), F.coalesce("shares", F.lit(1))).cast("int")).drop("shares")
    theirs = donors.join(shares, "cell", "left").withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1))).drop("shares")
    names = [F.col(c).alias(f"d_{c}") for c in theirs.columns]
    return mine.groupBy("cell", "block", "share").cogroup(theirs.select(*names).groupBy("d_cell", "d_block", "d_share")).applyInArrow(found, schema)


def stripes(n: int, rows: int = 256) -> Iterator[slice]:
    for at in range(0, n, rows):
        yield slice(at, min(n, at + rows))


def sample_nearest(points: DataFrame, width: int, size: int = 256) -> np.ndarray:
    """Exact nearest distances of a bounded sample of points (by id, drawn by hash), each compared with all points in blocks."""
    asked = points.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(size).select("id", "vec").collect()
    ids, x = np.array([r["id"] for r in asked], np.int64), np.array([r["vec"] for r in asked], np.float64).reshape(-1, width)
    shared = points.sparkSession.sparkContext.broadcast((ids, x))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, at = shared.value
        best = np.full(len(who), np.inf)
        for b in batches:
            y, own = np.array(b["vec"].tolist(), np.float64).reshape(-1, width), b["id"].to_numpy()
            for s in stripes(len(y), 1024):
                d = np.where(who[:, None] == own[None, s], np.inf, squared_gaps(at, y[s]))
                best = np.minimum(best, d.min(axis=1))
        yield pd.DataFrame({"place": np.arange(len(who)), "d": np.sqrt(best)})

    rows = points.select("id", "vec").mapInPandas(near, "place long, d double").groupBy("place").agg(F.min("d").alias("d")).collect()
    return np.sort([r["d"] for r in rows])
