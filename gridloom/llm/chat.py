"""Preference formatting: the shared turns of a chosen and a rejected conversation once as prompt, the rest as masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks of the chat markup.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE + "\n"))), "")


def learned_spans(turns: Column, role: str) -> Column:
    """Character spans [start, stop) of a rendering in which the loss counts: texts and end marks of turns of ``role``."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def step(s: Column, t: Column) -> Column:
        head = s["at"] + F.lit(len(OPEN) + 1) + F.length(t["role"])
        stop = head + F.length(t["text"]) + F.lit(len(CLOSE))
        span = F.array(F.struct(head.cast("int").alias("start"), stop.cast("int").alias("stop")))
        return F.struct((stop + 1).cast("int").alias("at"), F.when(t["role"] == role, F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(turns, state, step, lambda s: s["spans"])


def clean_turns(turns: Column) -> Column:
    """Turns without nulls: a missing list is empty, a missing turn or text is an empty text, a missing role is ``unknown``."""
    def fill(t: Column) -> Column:
        return F.struct(F.coalesce(t["role"], F.lit("unknown")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))

    return F.transform(F.coalesce(turns.cast(TURNS), F.array().cast(TURNS)), fill)


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected", role: str = "assistant") -> DataFrame:
    """``pairs`` with two lists of turns (structs with role and text) formatted for preference training.

    Replaces ``chosen`` and ``rejected`` by their renderings after the longest common prefix of equal turns, and adds
    n_prompt_turns, prompt, chosen_spans and rejected_spans (where the loss counts). If one conversation is the beginning of
    the other its completion is empty; equal conversations, or two empty ones, have two empty completions. Nulls: see
    ``clean_turns``. All other columns stay; those named like an added one are replaced. Row-wise: nothing is shuffled.
    """
    a, b = F.col("__a"), F.col("__b")
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first_other = F.array_position(same, False)
    shared = F.when(first_other > 0, first_other - 1).otherwise(F.size(same)).cast("int")
    base = pairs.withColumn("__a", clean_turns(F.col(chosen))).withColumn("__b", clean_turns(F.col(rejected))).withColumn("__n", shared)

    def rest(turns: Column) -> Column:
        return F.slice(turns, F.col("__n") + 1, F.greatest(F.size(turns) - F.col("__n"), F.lit(0)))

    made = {
        "n_prompt_turns": F.col("__n"), "prompt": render(F.slice(a, F.lit(1), F.col("__n"))),
        chosen: render(rest(a)), rejected: render(rest(b)), "chosen_spans": learned_spans(rest(a), role), "rejected_spans": learned_spans(rest(b), role),
    }
    return base.withColumns(made).drop("__a", "__b", "__n")


def conversations(turns: DataFrame) -> DataFrame:
    """One row per conv_id with its turns in order of (turn, role, text); nulls come first, a null conv_id is one conversation.

    One conversation is one value of the result, so its turns meet in one row by definition.
    """
    sorted_turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return turns.groupBy("conv_id").agg(F.transform(sorted_turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def swapped_replies(turns: DataFrame, role: str = "assistant") -> DataFrame:
    """Preference pairs from plain conversations: conv_id, chosen, rejected.

    Chosen is a conversation up to its last reply; rejected ends with the last reply of the neighbour (conv_id with the lowest
    bit flipped) in its place, or without a reply if there is no neighbour or it has none. A conversation without a reply is
    taken whole on both sides.
    """
    convs = conversations(turns)
    at = F.array_max(F.transform(F.col("turns"), lambda t, i: F.when(t["role"] == role, i + 1)))
    ends = convs.withColumn("last", at.cast("int")).withColumn("reply", F.when(F.col("last").isNotNull(), F.slice("turns", F.coalesce("last", F.lit(1)), 1)))
    others = ends.filter(F.col("conv_id").isNotNull() & F.col("last").isNotNull()).select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("reply").alias("other"))
    joined = ends.join(others, "conv_id", "left")
    before = F.slice("turns", F.lit(1), F.coalesce(F.col("last"), F.lit(1)) - 1)
    empty = F.array().cast(TURNS)
    chosen = F.when(F.col("last").isNull(), F.col("turns")).otherwise(F.concat(before, F.coalesce("reply", empty)))
    rejected = F.when(F.col("last").isNull(), F.col("turns")).otherwise(F.concat(before, F.coalesce(F.col("other").cast(TURNS), empty)))
    return joined.select("conv_id", chosen.alias("chosen"), rejected.alias("rejected"))
