"""Benchmark decontamination: a broadcast set of hashed benchmark word windows, rolled over whole training texts and verified."""

from __future__ import annotations

import hashlib
import re
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import add_columns
from gridloom.session import settle

WINDOW = 13
#: Texts of at most so many bytes are held in one broadcast set; a larger benchmark is scanned for in several blocks.
BLOCK_BYTES = 16 << 20

WORD_BYTES = frozenset(range(0x30, 0x3A)) | frozenset(range(0x61, 0x7B)) | frozenset(range(0x80, 0x100))
#: One byte to one byte: A-Z become small, every byte that is in no word becomes a space.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in WORD_BYTES else 0x20 for b in range(256))


def fold_words(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class WindowSet:
    """All windows of some benchmark items: for each window length sorted hashes, the words behind each, and its items."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in fold_words(text)]
            if ids:
                length = min(window, len(ids))
                for i in range(len(ids) - length + 1):
                    found.setdefault(length, {}).setdefault(tuple(ids[i : i + length]), set()).update([] if name is None else [name])
        self.factors = np.random.default_rng(13).integers(1, 1 << 63, window, dtype=np.uint64) | np.uint64(1)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, list[list[str]]]] = {}
        for length, windows in found.items():
            words = np.array(list(windows), dtype=np.int64)
            hashes = self.rolled(words, length)
            order = np.argsort(hashes, kind="stable")
            names = [sorted(x) for x in windows.values()]
            self.tables[length] = (hashes[order], words[order], [names[i] for i in order])

    def rolled(self, words: np.ndarray, length: int) -> np.ndarray:
        return ((words + 1).astype(np.uint64) * self.factors[:length]).sum(axis=1, dtype=np.uint64)

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, merged ranges [first, last) of hit word places, and names of the items that occur."""
        words = fold_words(text)
        n = len(words)
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, n)
        if not self.tables or not n or (ids < 0).all():
            return n, [], set()
        terms = (ids + 1).astype(np.uint64)
        edge, names = np.zeros(n + 1, np.int64), set()
        rolled = np.zeros(n, np.uint64)
        for j in range(min(n, max(self.tables))):
            rolled = rolled[: n - j] + terms[j:] * self.factors[j]
            if j + 1 in self.tables:
                hashes, known, items = self.tables[j + 1]
                left, right = np.searchsorted(hashes, rolled, "left"), np.searchsorted(hashes, rolled, "right")
                for at in np.flatnonzero(right > left):
                    for k in range(left[at], right[at]):
                        if (ids[at : at + j + 1] == known[k]).all():
                            edge[at] += 1
                            edge[at + j + 1] -= 1
                            names.update(items[k])
        hit = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
        change = np.flatnonzero(hit[1:] != hit[:-1])
        return n, list(zip(change[::2].tolist(), change[1::2].tolist())), names


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the bytes from the first to the last word of each span."""
    places = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(FOLD))]
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*kept, text[at:]])


def benchmark_blocks(benchmark: DataFrame, block_bytes: int) -> list[list[tuple[str | None, bytes | None]]]:
    """The benchmark's rows in lists of about ``block_bytes``, fetched one after the other: nothing larger is ever held."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // block_bytes) if total > block_bytes else 1
    rows = benchmark.select(F.col("item_id").cast("string").alias("name"), F.encode(F.col("text"), "UTF-8").alias("text"))
    part = F.pmod(F.xxhash64("name", "text"), F.lit(parts))
    for k in range(parts):
        yield [(r["name"], bytes(r["text"]) if r["text"] is not None else None) for r in rows.filter(part == k).collect()]


def mark_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, hit_spans (ranges of word places), items (names of occurring benchmark items), n_hit, contaminated.

    Words, windows and hits follow the contract: ``window`` consecutive words of an item, or all words of a shorter one.
    Contaminated: some word is hit, and at least one in twenty. A null or wordless text has no words and no hits; null or
    wordless items have no windows; an item without a name marks words but is not listed; repeated items count once. A column
    of a marked name is replaced, all others pass through. The set is broadcast; a benchmark beyond ``block_bytes`` is worked
    off in blocks of that size, each over all documents and settled before the next, so memory stays bounded and no hit is lost.
    """
    span = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("stop", T.IntegerType())]))
    fields = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", span), T.StructField("items", T.ArrayType(T.StringType()))]
    sc, out, held = docs.sparkSession.sparkContext, docs, None
    for block in benchmark_blocks(benchmark, block_bytes):
        shared = sc.broadcast(WindowSet(block, window))

        def scan(texts: list[bytes | None], shared=shared) -> list[list]:
            found = [shared.value.scan(t) for t in texts]
            return [[n for n, _, _ in found], [[{"first": a, "stop": b} for a, b in s] for _, s, _ in found], [sorted(x) for _, _, x in found]]

        if held is not None:
            out = settle(out.withColumnsRenamed({"hit_spans": "__spans", "items": "__items"}))
        out = add_columns(out, text, fields, scan)
        if held is not None:
            out = out.withColumn("hit_spans", F.concat("hit_spans", "__spans")).withColumn("items", F.array_union("items", "__items")).drop("__spans", "__items")
        held = block
    out = out.withColumn("hit_spans", merge_spans(F.col("hit_spans")))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda s, x: s + (x["stop"] - x["first"]).cast("long"))
    out = out.withColumn("n_hit", n_hit)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).withColumn("items", F.array_sort("items"))


def merge_spans(spans):
    """Sorted spans without overlaps, from the spans of several blocks."""
    def join(s, x):
        last = F.try_element_at(s, F.lit(-1))
        longer = F.concat(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))), F.array(F.struct(last["first"].alias("first"), F.greatest(last["stop"], x["stop"]).alias("stop"))))
        return F.when(last["stop"] >= x["first"], longer).otherwise(F.concat(s, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<first:int,stop:int>>"), join)


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    marked = mark_contamination(docs.select("doc_id", "text"), benchmark)
    return marked.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated documents; all columns as they were."""
    return _marked_aside(docs, benchmark).filter(~F.col("__contaminated")).select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with the text of every hit span cut out, contaminated or not; all rows stay."""
    def cut(both: list[bytes | None], spans: list) -> list:
        return [cut_spans(t, [(s["first"], s["stop"]) for s in x]) if x else t for t, x in zip(both, spans)]

    marked = _marked_aside(docs, benchmark)
    schema = marked.schema

    def run(batches):
        import pyarrow as pa

        from gridloom.llm.common import byte_texts, pieces

        for piece in pieces(batches, "text"):
            at = piece.schema.get_field_index("text")
            made = [None if t is None else t.decode() for t in cut(byte_texts(piece.column("text")), piece.column("__hit_spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(made, piece.schema.field(at).type) if i == at else c for i, c in enumerate(piece.columns)], names=piece.schema.names)

    return marked.mapInArrow(run, schema).select(*docs.columns)


def _marked_aside(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with the marks under names of their own, so that columns of the same names survive."""
    marks = ["n_words", "hit_spans", "items", "n_hit", "contaminated"]
    aside = docs.withColumnsRenamed({c: f"__kept_{c}" for c in docs.columns if c in marks})
    return mark_contamination(aside, benchmark).withColumnsRenamed({c: f"__{c}" for c in marks}).withColumnsRenamed({f"__kept_{c}": c for c in marks})
