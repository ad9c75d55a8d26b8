"""Sharding by jump consistent hashing (Lamping and Veach, 2014), with gapless places inside the shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import running_start
from gridloom.session import settle

#: Multiplier of the published generator, and 2**31 by which it divides.
MULTIPLIER = 2862933555777941757
DIVIDEND = 2147483648.0

LOW = (1 << 32) - 1


def _next_key(hi: Column, lo: Column) -> tuple[Column, Column]:
    """key * MULTIPLIER + 1 modulo 2**64, on two halves of 32 bits: no product or sum leaves a signed long, so ANSI mode is fine."""
    m_hi, m_lo = MULTIPLIER >> 32, MULTIPLIER & LOW

    def times(half: Column, factor: int) -> tuple[Column, Column]:
        """Low and upper 32 bits of half * factor, by 16-bit digits of the factor."""
        small, large = half * F.lit(factor & 0xFFFF), half * F.lit(factor >> 16)
        low = small.bitwiseAND(F.lit(LOW)) + F.shiftleft(large.bitwiseAND(F.lit(0xFFFF)), 16)
        return low, F.shiftright(small, 32) + F.shiftright(large, 16)

    low, up = times(lo, m_lo)
    low = low + F.lit(1)
    cross = times(lo, m_hi)[0] + times(hi, m_lo)[0]
    return (up + F.shiftright(low, 32) + cross).bitwiseAND(F.lit(LOW)), low.bitwiseAND(F.lit(LOW))


def jump(key: Column, shards: int) -> Column:
    """Struct (shard, grown): the shard of a long key among ``shards``, and among one shard more.

    The published loop jumps forward until it passes the number of shards. Its jumps don't depend on that number, so the shard
    among one more is the place of the last jump if that landed just behind the end. A null key counts as 0.
    """
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(LOW)).alias("lo"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j")
    )

    def hop(s: Column, _: Column) -> Column:
        hi, lo = _next_key(s["hi"], s["lo"])
        ahead = F.floor((s["j"] + 1).cast("double") * (F.lit(DIVIDEND) / (F.shiftright(hi, 1) + 1).cast("double"))).cast("long")
        return F.when(s["j"] < shards, F.struct(hi.alias("hi"), lo.alias("lo"), s["j"].alias("b"), ahead.alias("j"))).otherwise(s)

    def finish(s: Column) -> Column:
        return F.struct(s["b"].cast("int").alias("shard"), F.when(s["j"] == shards, F.lit(shards)).otherwise(s["b"]).cast("int").alias("grown"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, hop, finish)


def long_key(docs: DataFrame, key: str) -> Column:
    """``key`` itself where it is a whole number of up to 64 bits, else its hash (null stays null)."""
    if isinstance(docs.schema[key].dataType, T.IntegralType):
        return F.col(key).cast("long")
    return F.when(F.col(key).isNotNull(), F.xxhash64(key))


def assign_shards(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard), one for each document.

    ``key`` and the shard count alone decide the shard; one more shard takes rows only into itself. ``slot`` numbers the rows of
    a shard from 0 without gaps, by a hash of key, size and checksum. Rows that agree in all of these are counted as
    one row and dealt out again at the end, so a key repeated for a third of the table is no hot group. Nulls: a null text
    has no bytes (size 1) and no checksum, a null key counts as 0. A key that is no whole number (a text, a date) is hashed first. Many texts of one key spread over the
    blocks of its shard. An empty table gives no rows.
    """
    utf8 = F.encode(F.col(text), "UTF-8")
    rows = docs.select(F.col(key).alias("doc_id"), long_key(docs, key).alias("k"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(utf8).alias("text_crc32"))
    counted = rows.groupBy("doc_id", "k", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    placed = counted.withColumn("to", jump(F.col("k"), shards)).select("*", F.col("to.shard").alias("shard"), F.col("to.grown").alias("grown_shard"), F.xxhash64("doc_id", "size", "text_crc32").alias("order")).drop("to")
    blocked = settle(placed.withColumn("block", F.shiftrightunsigned("order", 54).cast("int")))
    started = running_start(blocked, "shard", "block", [F.col(c) for c in ("order", "doc_id", "size", "text_crc32")], F.col("n"), "start")
    dealt = started.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("copy")).alias("slot"), "grown_shard")
