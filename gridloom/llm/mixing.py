"""Mixing sources to target weights: hash-random order, distributed prefix sums of words, a cut at each source's exact budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import SPACED_WORD, running_start
from gridloom.session import settle

#: A source's random order is cut into 2**BLOCK_BITS ranges of the key, whatever the size of the table.
BLOCK_BITS = 10
KEY_BITS = 60


def words(text: Column) -> Column:
    """Number of space-separated words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def random_key(key: Column, seed: int) -> Column:
    """A number of KEY_BITS bits that only ``key`` and ``seed`` decide; md5 lets other engines compute it too."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """Targets of sources, from rows (source, source_size): weights repeat in code-point order, null last; no target exceeds
    ``cap`` times its source, and what is over is shared again by weight.

    Sharing again until nothing is over ends where target = least(weight * level, cap * size) for one level. Ordered by
    cap * size / weight, the capped sources come first, so running sums of caps and weights give the level at once.
    The table has one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    capped = weighed.withColumn("level", level).withColumn("capped", F.col("most") / F.col("w") <= F.col("level"))
    shared = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    return capped.withColumn("target", F.when(F.col("capped"), F.col("most")).otherwise(F.col("w") * shared)).select("source", "source_size", "target")


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 42) -> DataFrame:
    """How much the mix takes of each document: rows (doc_id, source, size, n_rows, start, source_size, target, budget).

    Rows that agree in doc_id, source and size are one row here with their number ``n_rows``: they can be told apart neither by
    the order nor by the result, and a document repeated for a third of the table stays one row. ``start`` is where the first
    of them begins in its source's random order. Nulls: a null text has no words, a null source is a source of its own, a null
    doc_id has the key of an empty text. An empty table gives no rows.
    """
    rows = docs.select("doc_id", "source", words(F.col("text")).alias("size"))
    counted = rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n_rows"))
    keyed = settle(counted.withColumn("key", random_key(F.col("doc_id"), seed)).withColumn("block", F.shiftright("key", KEY_BITS - BLOCK_BITS)))
    totals = keyed.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size"))
    targets = source_targets(totals, weights, cap).withColumnRenamed("source", "__source").withColumn("budget", F.floor(F.col("target") + 0.5).cast("long"))
    placed = running_start(keyed, "source", "block", [F.col("key"), F.col("doc_id"), F.col("size")], F.col("size") * F.col("n_rows"), "start")
    return placed.join(targets, F.col("source").eqNullSafe(F.col("__source"))).drop("__source", "key", "block")


def taken_words(start: Column) -> Column:
    """Words taken of a row that begins at ``start``: once per whole epoch of its source, then what is left of the budget."""
    full = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("budget") - full * F.col("source_size")
    return full * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - start)).cast("long")


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target and the words taken."""
    plan = mix_plan(docs, **how)
    each = plan.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_rows") - 1)))
    return each.select("doc_id", "source", "size", "source_size", "target", taken_words(F.col("start") + F.col("copy") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The mixed documents, with the columns of ``docs``: each as often as the epochs of its source say.

    The one document on which a source's budget ends is cut after the budget's last word (n_chars, if present, follows).
    A document without words has nothing to cut: it comes once for each begun epoch that reaches its place.
    """
    plan = mix_plan(docs, **how)
    key = ["doc_id", "source", "size"]
    facts = plan.select(*[F.col(c).alias(f"__{c}") for c in plan.columns])
    sized = docs.withColumn("__words", words(F.col("text")))
    met = sized.join(facts, F.col("doc_id").eqNullSafe(F.col("__doc_id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("__words") == F.col("__size")))
    copy = F.row_number().over(Window.partitionBy(*[f"__{c}" for c in key]).orderBy("text")) - 1
    full = F.when(F.col("__source_size") > 0, F.floor(F.col("__budget") / F.col("__source_size"))).otherwise(0).cast("int")
    rest = F.col("__budget") - full * F.col("__source_size")
    left = rest - (F.col("__start") + F.col("__copy") * F.col("__size"))
    placed = met.withColumn("__copy", copy).withColumn("__full", full).withColumn("__left", left)
    parts = F.concat(
        F.array_repeat(F.lit(-1).cast("long"), F.col("__full")),
        F.when((F.col("__left") > 0) & (F.col("__left") < F.col("__size")), F.array("__left")).when(F.col("__left") > 0, F.array(F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>")),
    )
    out = placed.withColumn("__part", F.explode(parts))
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col("text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, F.col("__part").cast("int")), "")
    out = out.withColumn("text", F.when(F.col("__part") < 0, F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("__part") < 0, F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out.select(*docs.columns)
