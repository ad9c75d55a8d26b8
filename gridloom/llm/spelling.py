"""Spelling variants: words one edit apart, found by walking a distributed trie level by level."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import byte_texts, pieces
from gridloom.session import settle

LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Every so-manieth run, by its checksum, loses a code point.
DROPPED = 199
#: Words up to this length walk the trie; the few longer ones meet by the hashes of what is left and right of an edit.
TRIE_LENGTH = 48
#: A task's counts go out when it holds so many distinct words.
HELD_WORDS = 1 << 18

RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")
SMALL = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Closes a word in the trie; no run holds it.
END = "."


def text_words(doc_id: object, text: bytes | None) -> Counter:
    """Words of one text with their counts; a shorter run can't become a word, so only runs long enough are read."""
    out: Counter = Counter()
    if text:
        start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
        for run, n in Counter(RUN.findall(text.translate(SMALL).decode("utf-8", "replace"))).items():
            h = zlib.crc32(run.encode(), start)
            if h % DROPPED == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= LEAST_LENGTH:
                out[run] += n
    return out


def corpus_words(docs: DataFrame) -> DataFrame:
    """(word, n): all words that occur often enough; counted within each task before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for piece in pieces(batches, "text"):
            for doc_id, text in zip(piece.column("doc_id").to_pylist(), byte_texts(piece.column("text"))):
                held.update(text_words(doc_id, text))
                if len(held) >= HELD_WORDS:
                    yield out()
                    held = Counter()
        if held:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def trie_edges(words: DataFrame) -> DataFrame:
    """(way, node, symbol, follows): one row an edge of the trie of the words (way 0) and of the reversed words (way 1).

    A node is its prefix; ``follows`` holds the symbols behind the edge, at most the alphabet, so that a walk looks one level
    ahead. Only the half of each word in which an edit may lie is needed, and what follows it.
    """
    whole = both_ways(words).withColumn("word", F.concat("word", F.lit(END)))
    places = whole.select("way", "word", F.explode(F.sequence(F.floor((F.length("word") - 1) / 2).cast("int") + 1, F.length("word"))).alias("p"))
    steps = places.select("way", F.substr("word", F.lit(1), F.col("p") - 1).alias("node"), F.substr("word", F.col("p"), F.lit(1)).alias("symbol")).distinct()
    # Follows of an edge are the symbols at its far end.
    follows = steps.groupBy("way", F.col("node").alias("child")).agg(F.array_join(F.array_sort(F.collect_set("symbol")), "").alias("follows"))
    return follows.select("way", F.expr("left(child, length(child) - 1)").alias("node"), F.expr("right(child, 1)").alias("symbol"), "follows")


def both_ways(words: DataFrame) -> DataFrame:
    """(way, word): every word as it is (way 0) and reversed (way 1)."""
    ways = F.array(F.struct(F.lit(0).alias("way"), "word"), F.struct(F.lit(1).alias("way"), F.reverse("word").alias("word")))
    return words.select(F.inline(ways))


def walk(words: DataFrame, longest: int) -> DataFrame:
    """(word, near): pairs one edit apart; a shorter word is found from the longer, of two equally long ones the one with the
    smaller symbol from the other.

    The frontier holds (way, word, place, node, edits). A state without an edit stands on its own word's path, in its second half
    only: edits of the first half are those of the second half of the reversed word, so a walk branches only where the trie is
    narrow. Each level joins the frontier with the edges: a state without an edit replaces its next symbol, or skips it and goes
    on with the one behind; one with an edit goes on with its next symbol. A state at the end of its word and of another is
    terminal. Nothing is capped; a hot node is one join key with at most an alphabet of edges, which the planner may split.
    """
    edges = settle(trie_edges(words))
    spelled = settle(both_ways(words))
    # Forwards from place floor(L / 2), backwards from ceil(L / 2): each place of an edit belongs to one way.
    half = F.when(F.col("way") == 0, F.floor(F.length("word") / 2)).otherwise(F.ceil(F.length("word") / 2))
    length = F.length("word")
    carried, found = None, []
    for depth in range(LEAST_LENGTH // 2, longest):
        frontier = spelled.where((half <= depth) & (length > depth)).select(F.col("way").alias("w"), "word", F.lit(depth).alias("place"), F.expr(f"left(word, {depth})").alias("at"), F.lit(0).alias("edits"))
        if carried is not None:
            frontier = frontier.unionByName(carried.select(F.col("way").alias("w"), "word", "place", F.col("node").alias("at"), "edits"))
        own, second, third = (F.substr(F.col("word"), F.col("place") + k, F.lit(1)) for k in (1, 2, 3))
        leads_to = lambda c: F.instr("follows", F.when(c == "", F.lit(END)).otherwise(c)) > 0
        fresh = F.col("edits") == 0
        goes_on = ~fresh & (F.col("symbol") == own) & leads_to(second)
        replaces = fresh & (F.col("symbol") < own) & leads_to(second)
        skips = fresh & (F.col("symbol") == second) & (own != second) & leads_to(third)
        shorter = fresh & (F.col("symbol") == own) & (F.col("place") == length - 2) & leads_to(F.lit(""))  # its last symbol skipped
        here = edges.where(F.length("node") == depth)
        stepped = frontier.join(here, (F.col("w") == F.col("way")) & (F.col("at") == F.col("node")) & (goes_on | replaces | skips | shorter))
        on = F.when(goes_on | replaces, F.col("place") + 1)
        places = F.array_compact(F.array(on, F.when(skips, F.col("place") + 2), F.when(shorter, length)))
        moved = settle(stepped.select("way", "word", F.explode(places).alias("place"), F.concat("node", "symbol").alias("node"), F.lit(1).alias("edits")))
        found.append(moved.where(F.col("place") == length).select("way", "word", F.col("node").alias("near")))
        carried = moved.where(F.col("place") < length)
    if not found:
        return words.select("word", F.col("word").alias("near")).limit(0)
    turn = lambda c: F.when(F.col("way") == 0, F.col(c)).otherwise(F.reverse(c)).alias(c)
    return reduce(lambda a, b: a.unionByName(b), found).select(turn("word"), turn("near")).distinct()


def long_pairs(words: DataFrame) -> DataFrame:
    """As ``walk``, but in either order, for pairs with a word longer than TRIE_LENGTH, whose levels would be too many.

    Each place of a long word is left out in turn; what is left is hashed, so a word of any length costs a few bytes a place.
    Words that agree on length, place and hash differ there only, so at most an alphabet of them meet; every pair is verified.
    """
    longer = words.where(F.length("word") > TRIE_LENGTH).select("word", F.xxhash64("word").alias("code"), F.length("word").alias("size"))
    left_out = longer.select("code", "size", F.explode(F.sequence(F.lit(1), F.col("size"))).alias("p"), "word").select(
        "code", "size", "p", F.xxhash64(F.concat(F.substr("word", F.lit(1), F.col("p") - 1), F.substr("word", F.col("p") + 1))).alias("rest"))
    left_out = settle(left_out)
    met = left_out.groupBy("size", "p", "rest").agg(F.collect_set("code").alias("codes")).where(F.size("codes") > 1)
    same = met.select("codes", F.explode("codes").alias("code")).select("code", F.explode("codes").alias("other")).where("code <> other").distinct()
    names = words.where(F.length("word") >= TRIE_LENGTH).select(F.xxhash64("word").alias("other"), F.col("word").alias("near"))
    less = left_out.select("code", F.col("rest").alias("other")).distinct()
    pairs = same.union(less).distinct().join(names, "other").join(longer.select("code", "word"), "code").select("word", "near")
    return pairs.where(F.levenshtein("word", "near", 1) == 1)


def near_words(words: DataFrame) -> DataFrame:
    """(word, near): all pairs of words that differ by one inserted, deleted or replaced code point, in both orders."""
    longest = words.agg(F.max(F.length("word"))).first()[0] or 0
    pairs = walk(words.where(F.length("word") <= TRIE_LENGTH).select("word"), min(longest, TRIE_LENGTH))
    if longest > TRIE_LENGTH:
        pairs = pairs.union(long_pairs(words))
    return pairs.union(pairs.select("near", "word")).distinct()


def follow_forms(forms: DataFrame, most: int) -> DataFrame:
    """(word, root) of (word, form), by pointer doubling; a form occurs RATIO times as often as its word, which bounds every
    chain by the logarithm of the largest count."""
    steps, reach = 1, LEAST_COUNT
    while reach * RATIO <= most:
        steps, reach = steps + 1, reach * RATIO
    roots = forms.select("word", F.col("form").alias("root"))
    for _ in range(steps.bit_length()):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = settle(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return roots


def spelling_report(docs: DataFrame) -> DataFrame:
    """Query rows: every word with its form and root.

    Null texts have no words, a null id counts as an empty one, repeated rows count as often as they occur; ties of the largest
    near word go to the smaller one. An empty table gives no rows. Columns other than doc_id and text are not read.
    """
    words = settle(corpus_words(docs))
    most = words.agg(F.max("n")).first()[0] or 0
    pairs = near_words(words)
    ranked = pairs.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    known = settle(words.join(ranked, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.less") >= RATIO * F.col("n"), F.col("best")).alias("best")))
    known = known.select("word", "n", "n_near", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))
    roots = follow_forms(known.where("form IS NOT NULL"), most)
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
