"""Exact nearest rows by boxes: cells of a k-d tree spread the donors, and a finer tree inside a cell finds the nearest ones.

Vectors, patterns and distances are as in ``metric``; ``Boxes`` takes the place of ``Cells`` in ``metric.meet``. A box bounds
every component apart, so it also parts rows for a seeker that knows only some of them. All bounds are computed in the same
steps as the distances they bound, so rounding never hides a row.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.plans import metric
from gridloom.plans.metric import matrix, shared_components, stripes
from gridloom.session import settle

#: Cells over all donors, and donors drawn for each to place the cuts; donors in a leaf of the tree inside a cell.
CELLS, DRAWN, LEAF = 512, 64, 32
#: Pairs of a row and a leaf that are compared at once.
PAIRS = 1 << 14


@dataclass
class Boxes:
    """What every task knows: the cuts of one tree a pattern, and of each cell the bounds of its rows, their number and weight."""

    width: int
    roots: dict[bytes, int] = field(default_factory=dict)  # by pattern
    nodes: list[tuple[int, float, int, int]] = field(default_factory=list)  # component, cut, node up to it, node beyond; -1, 0, cell, 0
    cells: int = 0
    low: np.ndarray | None = None  # the open cell last, for rows of rare patterns: it has no bounds
    high: np.ndarray | None = None
    weight: np.ndarray | None = None
    blocks: np.ndarray | None = None
    k: int = 1

    def grow(self, x: np.ndarray, known: np.ndarray, cells: int) -> int:
        """The node of a tree that cuts rows like ``x`` into cells of about as many rows; the number of the node."""
        at, best = len(self.nodes), None
        self.nodes.append((-1, 0.0, self.cells, 0))
        if cells > 1 and len(x) > 1:
            spans = np.where(known, x.max(axis=0) - x.min(axis=0), -1.0)
            if spans.max() > 0:
                best = int(spans.argmax())
        if best is None:
            self.cells += 1
            return at
        v = np.sort(x[:, best])
        edges = np.flatnonzero(v[1:] > v[:-1])
        edge = edges[np.abs(edges + 1 - len(v) * (cells // 2) / cells).argmin()]
        low = x[:, best] <= v[edge]
        left = self.grow(x[low], known, cells // 2)
        self.nodes[at] = (best, float(v[edge]), left, self.grow(x[~low], known, cells - cells // 2))
        return at

    def homes(self, x: np.ndarray) -> np.ndarray:
        """The cell of each donor; the open one where its pattern has no tree."""
        out = np.full(len(x), self.cells)
        dims, cuts, left, right = (np.array(c) for c in zip(*self.nodes)) if self.nodes else (None,) * 4
        for pattern, rows in by_pattern(x):
            root = self.roots.get(pattern.tobytes())
            if root is None:
                continue
            at = np.full(len(rows), root)
            while (inner := dims[at] >= 0).any():
                some = at[inner]
                low = x[rows[inner], dims[some]] <= cuts[some]
                at[inner] = np.where(low, left[some], right[some])
            out[rows] = left[at]
        return out

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """No row of a cell is nearer than its bound. Second: about how far the k-th row may be, for the choice of the first cell."""
        shared = shared_components(x, self.low)
        shared[:, -1] = np.where(self.weight[-1] > 0, self.width, 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(shared > 0, self.width / shared, np.inf)
            low = np.where(shared > 0, np.sqrt(box_gaps(x, self.low, self.high) * scale), np.inf)
        worth = low.copy()
        for pattern, rows in by_pattern(x):
            worth[rows] += self.about(pattern)
        worth[:, -1] = 1e300 if self.weight[-1] > 0 else np.inf
        return low, worth

    def about(self, pattern: np.ndarray) -> np.ndarray:
        """How far the k-th row of each cell may be from a row of a pattern; cells that weigh less than k come last. A seeker must find
        the same first cell whichever rows it comes with, so this is worked out for the pattern alone."""
        both = pattern & ~np.isnan(self.low)
        shared = np.maximum(1, both.sum(axis=1))
        with np.errstate(divide="ignore", invalid="ignore"):
            spans = np.where(both, np.log(self.high - self.low + 1e-12), 0.0).sum(axis=1)
            far = np.exp((spans + np.log(self.k / self.weight)) / shared) * np.sqrt(self.width / shared)
        return np.where(self.weight < self.k, 1e100, far)


def by_pattern(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The patterns of known components met in ``x``, each with its rows."""
    kinds, of = np.unique(~np.isnan(x), axis=0, return_inverse=True)
    order = np.argsort(of.ravel(), kind="stable")
    return list(zip(kinds, np.split(order, np.cumsum(np.bincount(of.ravel(), minlength=len(kinds)))[:-1])))


def box_gaps(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Summed squares of what parts each row from each box, over the components that both know."""
    out = np.zeros((len(x), len(low)))
    for a, b, c in zip(x.T, low.T, high.T):
        d = np.fmax(np.fmax(b[None, :] - a[:, None], a[:, None] - c[None, :]), 0.0)
        out += d * d
    return out


def settle_boxes(donors: DataFrame, width: int, k: int) -> tuple[Boxes, DataFrame]:
    """Boxes over ``donors`` (with vec, all different, and a weight w) and the donors themselves, settled, with cell and block.

    The cuts are quantiles of donors drawn by a hash, in each pattern by its share; the boxes hold all donors.
    """
    spark = donors.sparkSession
    donors = settle(donors.withColumn("pattern", metric._pattern(F.col("vec"))))
    sizes = donors.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "pattern").limit(metric.PATTERNS).collect()
    n, most = sum(r["n"] for r in sizes), 4 * metric.PIECE
    quota = {r["pattern"]: max(1, round(min(CELLS, ceil(n / most)) * r["n"] / n)) for r in sizes}
    asked = [(r["pattern"], int(min(1.0, quota[r["pattern"]] * DRAWN / r["n"]) * (1 << 30))) for r in sizes if quota[r["pattern"]] > 1]
    drawn: dict[str, list] = {p: [] for p in quota}
    if asked:
        shares = F.broadcast(spark.createDataFrame(asked, "pattern string, share long"))
        for r in donors.join(shares, "pattern").where(F.pmod(F.xxhash64("vec", F.lit(11)), F.lit(1 << 30)) < F.col("share")).select("pattern", "vec").collect():
            drawn[r["pattern"]].append([np.nan if v is None else v for v in r["vec"]])
    boxes = Boxes(width, k=k)
    for pattern, rows in drawn.items():
        known, x = np.array([c == "1" for c in pattern]), np.array(rows, np.float64).reshape(-1, width)
        boxes.roots[known.tobytes()] = boxes.grow(x[np.lexsort(x.T)], known, quota[pattern])
    bare = spark.sparkContext.broadcast(boxes)
    schema = T.StructType([*donors.drop("pattern", "cell").schema.fields, T.StructField("cell", T.IntegerType())])
    names = [f.name for f in schema]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bare.value.homes(matrix(batch.column("vec"), width)), pa.int32())], names=names)

    placed = settle(donors.drop("pattern", "cell").mapInArrow(place, schema))
    ends = [f(F.get("vec", F.lit(i))).alias(f"{name}{i}") for i in range(width) for name, f in (("low", F.min), ("high", F.max))]
    facts = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), *ends).collect()
    boxes.low, boxes.high = np.full((boxes.cells + 1, width), np.nan), np.full((boxes.cells + 1, width), np.nan)
    boxes.weight, boxes.blocks = np.zeros(boxes.cells + 1), np.ones(boxes.cells + 1, np.int64)
    largest = 4 * max(most, ceil(n / CELLS))
    for r in facts:
        boxes.weight[r["cell"]], boxes.blocks[r["cell"]] = r["w"], ceil(r["n"] / largest)
        if r["cell"] < boxes.cells:
            boxes.low[r["cell"]], boxes.high[r["cell"]] = ([np.nan if r[f"{e}{i}"] is None else r[f"{e}{i}"] for i in range(width)] for e in ("low", "high"))
    blocks = F.broadcast(spark.createDataFrame([(i, int(b)) for i, b in enumerate(boxes.blocks)], "cell int, blocks int"))
    return boxes, placed.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("vec", F.lit(1)), "blocks").cast("int")).drop("blocks")


# --- inside a cell ----------------------------------------------------------------------------------------------------


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of ``x``, and which of them each row is."""
    order = np.lexsort(x.T)
    new = np.append(True, (x[order[1:]] != x[order[:-1]]).any(axis=1))
    which = np.empty(len(x), np.int64)
    which[order] = np.cumsum(new) - 1
    return x[order[new]], which


def leaves(x: np.ndarray, size: int) -> np.ndarray:
    """Rows of ``x`` by number in leaves of ``size`` places, cut at the median of the widest component of each node; -1: no row.
    Places left over are spread over all leaves, as copies of rows that are taken out at the end."""
    halvings = max(0, int(np.ceil(np.log2(len(x) / size))))
    spare = (1 << halvings) * size - len(x) if halvings else 0
    filled = np.vstack([x, x[np.linspace(0, len(x), spare, endpoint=False).astype(np.int64)]])
    places = np.arange(len(filled))[None, :]
    for _ in range(halvings):
        rows = filled[places]
        spans = rows.max(axis=1) - rows.min(axis=1)
        key = np.take_along_axis(rows, spans.argmax(axis=1)[:, None, None], axis=2)[:, :, 0]
        places = np.take_along_axis(places, np.argsort(key, axis=1), axis=1).reshape(len(places) * 2, -1)
    return np.where(places < len(x), places, -1)


def nearest_levels(x: np.ndarray, reach: np.ndarray, y: np.ndarray, w: np.ndarray, wv: np.ndarray, scale: float, k: int, decimals: int) -> tuple[np.ndarray, ...]:
    """(row of ``x``, distance, w, wv): the distances from each row, in order, up to the one that completes a weight of ``k`` among the
    rows of ``y`` (each weighs at least 1), none beyond ``reach``. Everything is known; ``scale`` multiplies the squared distances."""
    parts = []
    places = leaves(y, max(LEAF, 4 * k))
    rows = np.vstack([y, np.full((1, y.shape[1]), np.nan)])[places]
    low, high = np.fmin.reduce(rows, axis=1), np.fmax.reduce(rows, axis=1)

    def gaps(who: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        out = np.zeros((len(who), places.shape[1]))
        for c in range(x.shape[1]):
            d = x[who, c][:, None] - rows[leaf, :, c]
            out += d * d
        return np.round(np.sqrt(out * scale), decimals)

    for s in stripes(len(x), max(1, (1 << 21) // len(places))):
        near = np.round(np.sqrt(box_gaps(x[s], low, high) * scale), decimals)
        own, most = near.argmin(axis=1), reach[s].copy()
        for t in stripes(len(own), PAIRS):
            d = np.nan_to_num(gaps(np.arange(s.start, s.stop)[t], own[t]), nan=np.inf)
            if k <= d.shape[1]:
                most[t] = np.minimum(most[t], np.partition(d, k - 1, axis=1)[:, k - 1])
        who, leaf = np.nonzero(near <= most[:, None])
        for t in stripes(len(who), PAIRS):
            d = gaps(who[t] + s.start, leaf[t])
            pair, place = np.nonzero(d <= most[who[t]][:, None])
            donor = places[leaf[t][pair], place]
            at, d = who[t][pair] + s.start, d[pair, place]
            parts.append(levels(at, d, w[donor], wv[donor], k))
    if not parts:
        return (*(np.zeros(0, kind) for kind in (np.int64, np.float64, np.float64, np.float64)),)
    return levels(*(np.concatenate(c) for c in zip(*parts)), k)


def levels(at: np.ndarray, d: np.ndarray, w: np.ndarray, wv: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Equal distances of a row together, in order, without those that begin when ``k`` are complete."""
    order = np.lexsort((d, at))
    at, d = at[order], d[order]
    new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (d[1:] != d[:-1]))[: len(at)])
    if not len(new):
        return at, d, w[order], wv[order]
    at, d, w, wv = at[new], d[new], np.add.reduceat(w[order], new), np.add.reduceat(wv[order], new)
    before = np.cumsum(w) - w
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    before -= np.repeat(before[first], np.diff(np.append(first, len(at))))
    keep = before < k
    return at[keep], d[keep], w[keep], wv[keep]
