"""Near-duplicate vectors by spherical-cap filters: random product codes (Becker, Ducas, Gama, Laarhoven, 2016), list decoding."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.graph import components
from gridloom.session import settle

#: Vectors of one bucket compared in one piece; a larger bucket is cut into blocks, and each pair of blocks is a piece.
BLOCK = 512


@dataclass(frozen=True)
class ProductCode:
    """Filters are concatenations of one code vector for each of ``blocks`` parts of a randomly rotated vector.

    ``each`` code vectors a block make each**blocks filters. A vector takes every filter it has an inner product of at least
    the threshold with: the value that ``listed`` of the random filters exceed on average, whatever the data.
    If fewer than ``least`` do, it takes its ``least`` best ones instead, so no vector is without filters.
    """

    blocks: int = 2
    each: int = 64
    listed: int = 16
    least: int = 8
    seed: int = 7

    def arrays(self, dims: int) -> tuple[np.ndarray, list[np.ndarray], float]:
        rng = np.random.default_rng(self.seed)
        rotation = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
        cuts = np.array_split(np.arange(dims), min(self.blocks, dims))
        codes = []
        for cut in cuts:
            code = rng.standard_normal((self.each, len(cut)))
            codes.append(code / np.linalg.norm(code, axis=1, keepdims=True) * np.sqrt(len(cut) / dims))
        share = self.listed / self.each ** len(cuts)
        return rotation, codes, NormalDist().inv_cdf(1 - min(share, 0.5)) / np.sqrt(dims)

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List decoding of unit vectors: pairs (row, filter). Block after block, a partial product is kept only if the best of
        the blocks to come could lift it over the threshold."""
        rotation, codes, threshold = self.arrays(unit.shape[1])
        turned, at, parts = unit @ rotation, 0, []
        for code in codes:
            parts.append(turned[:, at : at + code.shape[1]] @ code.T)
            at += code.shape[1]
        tops = [p.max(axis=1) for p in parts]
        row, name, score = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
        for k, part in enumerate(parts):
            rest = sum(tops[k + 1 :], np.zeros(len(unit)))
            total = score[:, None] + part[row]
            keep = total + rest[row][:, None] >= threshold
            which, code = np.nonzero(keep)
            row, name, score = row[which], name[which] * self.each + code, total[which, code]
        short = np.flatnonzero(np.bincount(row, minlength=len(unit)) < self.least)
        if len(short):
            more_row, more_name = self._best(parts, short)
            other = ~np.isin(row, short)
            row, name = np.concatenate([row[other], more_row]), np.concatenate([name[other], more_name])
        return row, name

    def _best(self, parts: list[np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ``least`` best filters of some rows: they are made of the ``least`` best code vectors of each block."""
        name, score = np.zeros((len(rows), 1), np.int64), np.zeros((len(rows), 1))
        for part in parts:
            best = np.argsort(-part[rows], axis=1)[:, : self.least]
            name = (name[:, :, None] * self.each + best[:, None, :]).reshape(len(rows), -1)
            score = (score[:, :, None] + np.take_along_axis(part[rows], best, 1)[:, None, :]).reshape(len(rows), -1)
            top = np.argsort(-score, axis=1)[:, : self.least]
            name, score = np.take_along_axis(name, top, 1), np.take_along_axis(score, top, 1)
        return np.repeat(rows, name.shape[1]), name.ravel()


def vector_classes(vectors: DataFrame) -> DataFrame:
    """One row (cls, label, embedding, n, least) for each distinct vector of a label that may link at all."""
    sound = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return vectors.filter(sound).filter(finite).groupBy("cls", "label", "embedding").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))


def filter_rows(classes: DataFrame, code: ProductCode) -> DataFrame:
    """Rows (cls, label, n, embedding, filters): the list-decoded filters of each class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, lists = batch.column("embedding").to_pylist(), [None] * batch.num_rows
            sizes = np.array([len(v) for v in vectors])
            for dims in np.unique(sizes):
                rows = np.flatnonzero(sizes == dims)
                found = unit_rows([vectors[i] for i in rows])
                row, name = code.decode(found)
                order = np.lexsort((name, row))
                cuts = np.searchsorted(row[order], np.arange(1, len(rows)))
                for i, names in zip(rows, np.split(name[order], cuts)):
                    lists[i] = names.tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int64()))], names=[*batch.schema.names, "filters"])

    kind = classes.schema["label"].dataType.simpleString()
    of = classes.schema["embedding"].dataType.simpleString()
    return classes.select("cls", "label", "n", "embedding").mapInArrow(run, f"cls string, label {kind}, n long, embedding {of}, filters array<long>")


def unit_rows(vectors: list | np.ndarray) -> np.ndarray:
    rows = np.array(vectors, dtype=np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def linked(piece: pa.Table, at_least: float) -> pa.Table:
    """Links inside one piece of a bucket: for each class the rows it links to, and an edge to the smallest class of its part.

    A pair that meets in several buckets counts only in the smallest filter the two share. Vectors of another length never link.
    """
    here, across = piece["filter"][0].as_py(), piece["a"][0] != piece["b"][0]
    vectors, names, links, roots = piece["embedding"].combine_chunks(), [], [], []
    sizes = np.diff(vectors.offsets.to_numpy())
    for dims in np.unique(sizes):
        rows = np.flatnonzero(sizes == dims)
        unit = unit_rows(vectors.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), dims))
        near = unit @ unit.T >= at_least
        np.fill_diagonal(near, False)
        if across:
            block = piece["block"].to_numpy()[rows]
            near &= block[:, None] != block[None, :]
        who = np.flatnonzero(near.any(axis=1))
        if not len(who):
            continue
        some = piece.select(["cls", "n", "filters"]).take(pa.array(rows[who]))
        near, n, cls = near[np.ix_(who, who)], some["n"].to_numpy(), some["cls"].to_numpy()
        before = [[f for f in x if f < here] for x in some["filters"].to_pylist()]
        known = {f: i for i, f in enumerate(sorted({f for x in before for f in x}))}
        member = np.zeros((len(who), len(known)), np.float32)
        for i, x in enumerate(before):
            member[i, [known[f] for f in x]] = 1
        new = near & (member @ member.T < 0.5) if known else near
        least, changed = np.argsort(np.argsort(cls)), True
        order = np.sort(cls)
        while changed:  # each step takes the smallest class among a vector's links
            best = np.minimum(np.where(near, least[None, :], len(who)).min(axis=1), least)
            changed = bool((best != least).any())
            least = best
        names.append(cls)
        links.append(new @ n)
        roots.append(order[least])
    kinds = pa.schema([("cls", pa.string()), ("links", pa.int64()), ("root", pa.string())])
    if not names:
        return kinds.empty_table()
    return pa.table([pa.array(np.concatenate(x), kind.type) for x, kind in zip((names, links, roots), kinds)], schema=kinds)


def link_vectors(vectors: DataFrame, at_least: float = 0.98, code: ProductCode = ProductCode(), block: int = BLOCK) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept) for each row of (vec_id, embedding, label).

    Equal vectors of a label are one class with a count. Classes meet in buckets (label, filter); pairs are verified by cosine
    in double precision and counted inside their piece, never written out. A bucket of more than ``block`` classes is cut into
    blocks, each pair of which is a piece of bounded size: nothing is capped. Recall is that of the code (measured in the
    tests); every link found is at least ``at_least``.

    Nulls: a vector that is null, zero or has null or non-finite components, or whose label is null, has no links and is its
    own component. A row without vec_id links with nothing, its component is null and it isn't kept. Repeated rows link with
    each other like other equal vectors; rows with one vec_id but other vectors are distinct rows. No rows give no rows.
    """
    cls = F.concat(F.hex(F.xxhash64("label", "embedding")), F.lit(":"), F.hex(F.xxhash64("embedding", "label", F.lit(1))))
    named = vectors.select("vec_id", "embedding", "label").withColumn("cls", cls)
    classes = settle(vector_classes(named))
    decoded = settle(filter_rows(classes, code))
    spread = decoded.withColumn("filter", F.explode("filters"))
    sizes = spread.groupBy("label", "filter").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    met = spread.join(sizes, ["label", "filter"]).withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    mine = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pieces = met.withColumn("block", mine).withColumn("__other", other).select("label", "filter", "cls", "n", "embedding", "filters", "block", F.least("block", "__other").alias("a"), F.greatest("block", "__other").alias("b"))
    found = settle(pieces.groupBy("label", "filter", "a", "b").applyInArrow(lambda piece: linked(piece, at_least), "cls string, links long, root string"))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    parts = components(found.filter("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b")))
    rooted = classes.select("cls", "n", "least").join(parts.withColumnRenamed("node", "cls"), "cls", "left").join(links, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    facts = rooted.join(smallest, "root").select("cls", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component")
    joined = named.withColumn("cls", F.when(F.col("vec_id").isNotNull(), F.col("cls"))).join(facts, "cls", "left")
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
