"""Line dedup by overlapping windows of three lines: later occurrences of a window go, wherever they are."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import SPACED_WORD, byte_texts, pieces

LINES = 3
#: A line of more words than this is a passage by itself, whatever stands around it.
PASSAGE_WORDS = 50


def line_windows(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """Rows (doc_id, mark, place, span, w1, w2): every window of ``span`` lines from ``place`` on, as two hashes of its lines.

    Windows are ``lines`` consecutive lines, all lines of a text that has fewer, and each line of over PASSAGE_WORDS words
    alone. A null or empty text has none. Rows that agree in doc_id and text are one document here.
    """
    each = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.split("text", "\n").alias("lines")).filter(F.length("text") > 0)
    words = lambda x: F.when(F.length(x) > 2 * PASSAGE_WORDS, F.regexp_count(x, F.lit(SPACED_WORD))).otherwise(0)
    line = lambda x: F.struct(F.xxhash64(x).alias("p"), F.xxhash64(x, F.lit(1)).alias("q"), (words(x) > PASSAGE_WORDS).alias("passage"))
    hashed = each.select("doc_id", "mark", F.transform("lines", line).alias("h"))
    window = lambda place, span: F.struct(place.cast("int").alias("place"), span.cast("int").alias("span"))
    span = F.least(F.size("h"), F.lit(lines))
    rows = F.transform(F.sequence(F.lit(0), F.size("h") - span), lambda i: window(i, span))
    passages = F.filter(F.transform("h", lambda x, i: F.when(x["passage"], window(i, F.lit(1)))), lambda x: x.isNotNull())
    windows = hashed.select("doc_id", "mark", "h", F.inline(F.array_union(rows, passages)))
    inside = lambda part: F.slice(F.col(f"h.{part}"), F.col("place") + 1, F.col("span"))
    return windows.select("doc_id", "mark", "place", "span", F.xxhash64(inside("p")).alias("w1"), F.xxhash64(inside("q")).alias("w2"))


def later_occurrences(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """Rows (doc_id, mark, places): place and span of the windows that occur earlier, in order of doc_id (null first), text, place.

    The first occurrence of each repeated window is one pre-aggregated row; only windows that do repeat meet it in the join,
    and the join may split a window that a third of all documents share.
    """
    windows = line_windows(docs, lines)
    here = F.struct("doc_id", "mark", "place")
    firsts = windows.groupBy("span", "w1", "w2").agg(F.min(here).alias("first"), F.max(here).alias("last")).filter(~F.col("first").eqNullSafe(F.col("last"))).select("span", "w1", "w2", "first")
    later = windows.join(firsts, ["span", "w1", "w2"]).filter(~here.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set(F.struct("place", "span"))).alias("places"))


def removed_lines(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Merged ranges [first, stop) of the lines that ``windows`` (place and span, sorted) cover."""
    out: list[tuple[int, int]] = []
    for place, span in windows:
        if out and place <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], place + span))
        else:
            out.append((place, place + span))
    return out


def dedup_lines(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """``docs`` with the lines cut that belong to later occurrences of a repeated window; adds n_lines and n_removed.

    Lines are parted by a newline and compared exactly. A line goes if any later occurrence of a window covers it; covered
    places that touch or overlap are cut as one range. A document all of whose lines go keeps an empty text. A text of fewer
    than three lines is one window of all its lines, and goes whole where an earlier text is the same; a line of over
    PASSAGE_WORDS words is a window by itself too. An empty text stays; a null text stays null with no lines. Rows that agree in doc_id and text get the
    same result; a null doc_id comes before all others. Columns of the added names are replaced, all others pass through.
    """
    places = later_occurrences(docs, lines).select(F.col("doc_id").alias("__id"), F.col("mark").alias("__of"), F.col("places").alias("__places"))
    marked = docs.drop("n_lines", "n_removed").withColumn("__mark", F.xxhash64("text"))
    joined = marked.join(places, marked["doc_id"].eqNullSafe(places["__id"]) & (marked["__mark"] == places["__of"]), "left").drop("__id", "__of", "__mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            texts, counts, cuts = [], [], []
            for text, at in zip(byte_texts(piece.column("text")), piece.column("__places").to_pylist()):
                split = [] if text is None else text.split(b"\n")
                gone = removed_lines([(w["place"], w["span"]) for w in at or []])
                stay, start = [], 0
                for a, b in gone:
                    stay += split[start:a]
                    start = b
                stay += split[start:]
                texts.append(None if text is None else b"\n".join(stay).decode())
                counts.append(len(split))
                cuts.append(sum(b - a for a, b in gone))
            made = {"text": pa.array(texts, piece.schema.field("text").type)}
            kept = [(n, made.get(n, c)) for n, c in zip(piece.schema.names, piece.columns) if n != "__places"]
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), pa.array(counts, pa.int64()), pa.array(cuts, pa.int64())], names=[*(n for n, _ in kept), "n_lines", "n_removed"])

    from pyspark.sql import types as T

    schema = T.StructType([*(f for f in joined.schema.fields if f.name != "__places"), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    return joined.mapInArrow(run, schema)
