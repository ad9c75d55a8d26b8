"""SimHash near-duplicates: Golay-code fuzzy hashing of fingerprint segments, a join on the keys, and verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import add_columns
from gridloom.llm.golay import near_codewords
from gridloom.llm.graph import components
from gridloom.session import settle

SHINGLE, SEED, MOST_BITS = 3, 42, 2
#: Fixed by the method: two errors leave one of three segments of the 64 bits (first bit, bits) as it is.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints with one key up to which all their pairs are compared; larger groups are linked through common neighbours.
PAIR_GROUP = 16

FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def fingerprint(text: bytes | None) -> int:
    """64-bit SimHash of the 3-word shingles of a whole text: a bit is set if it is set in over half of the shingle hashes."""
    words = text.translate(FOLD).split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    stops = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(SHINGLE, len(words))
    starts = np.concatenate([[0], stops[:-1] + 1])[: len(words) - k + 1].tolist()
    hashed = xxhash.xxh64_intdigest
    votes, n = np.zeros(64, np.int64), len(starts)
    stops = stops[k - 1 :].tolist()
    for a in range(0, n, 1 << 14):
        hashes = np.array([hashed(line[s:e], SEED) for s, e in zip(starts[a : a + (1 << 14)], stops[a : a + (1 << 14)])], dtype=np.uint64)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, mark, fp): ``mark`` is a hash of the text, ``fp`` the fingerprint as a signed long (0 for a null or wordless text)."""
    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    return add_columns(rows, "text", [T.StructField("fp", T.LongType())], lambda texts: [[fingerprint(t) for t in texts]]).drop("text")


def golay_keys(distinct: DataFrame) -> DataFrame:
    """Rows (bucket, fp): three times up to six keys for each fingerprint.

    A key joins one segment as it is with one near codeword of the segment after it. Fingerprints at two bits or less agree in
    some segment (pigeonhole), and the next one differs in at most two bits, so they share a codeword there: none is missed.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column(0)).astype(np.int64)
            cut = [(fp.view(np.uint64) >> np.uint64(a) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
            for k in range(len(SEGMENTS)):
                index, counts = near_codewords(cut[(k + 1) % len(SEGMENTS)])
                bucket = (k << 34 | cut[k] << 12)[:, None] | index
                yield pa.RecordBatch.from_arrays([pa.array(bucket[counts]), pa.array(np.repeat(fp, counts.sum(axis=1)))], names=["bucket", "fp"])

    return distinct.select("fp").mapInArrow(run, "bucket long, fp long")


def near_links(distinct: DataFrame, pair_group: int = PAIR_GROUP) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct fingerprints connected by chains of steps of at most two bits.

    Small buckets: all their pairs, verified. Large buckets never emit pairs: two fingerprints are within two bits if and only
    if some 64-bit word is within one bit of both, so each fingerprint meets the others at its 65 nearest words and is linked
    to the smallest one there. Bucket sizes are counted first, with partial sums.
    """
    keyed = golay_keys(distinct)
    crowded = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = settle(keyed.join(crowded, "bucket"))
    few = met.filter(F.col("n") <= pair_group)
    pairs = few.select("bucket", F.col("fp").alias("a")).join(few.select("bucket", F.col("fp").alias("b")), "bucket").filter("a > b")
    verified = pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_BITS).select("a", "b")
    many = met.filter(F.col("n") > pair_group).select("fp").distinct()
    flips = F.transform(F.sequence(F.lit(-1), F.lit(63)), lambda i: F.when(i < 0, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    balls = many.select("fp", F.explode(flips).alias("word"))
    least = balls.groupBy("word").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("word", "b")
    through = balls.join(least, "word").filter("fp > b").select(F.col("fp").alias("a"), "b")
    return verified.unionByName(through).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, mark, fp, root, component_id) for every document: component_id is the smallest doc_id that links reach.

    Documents with one fingerprint are one node, however many they are; only distinct fingerprints are keyed, joined and
    linked. A null doc_id takes part but is never the smallest (a component of such rows alone has a null id). Repeated rows
    are equal rows of the result. Very long texts are hashed whole, a block of shingles at a time; no rows give no rows.
    """
    marked = settle(fingerprints(docs))
    distinct = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(near_links(distinct))
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")
    return marked.join(named, "fp").select("doc_id", "mark", "fp", "root", "component_id")


def duplicates_report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: the smallest doc_id (null last), then the smallest hash of
    the text; of rows that agree in both, one."""
    least = near_duplicates(docs).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("least"))
    chosen = least.select(F.col("least.doc_id").alias("__id"), F.col("least.mark").alias("__chosen"))
    marked = docs.withColumn("__mark", F.xxhash64("text"))
    kept = marked.join(chosen, marked["doc_id"].eqNullSafe(chosen["__id"]) & (marked["__mark"] == chosen["__chosen"]), "left_semi")
    once = F.row_number().over(Window.partitionBy("doc_id", "__mark").orderBy("doc_id"))
    return kept.withColumn("__once", once).filter("__once = 1").select(*docs.columns)
