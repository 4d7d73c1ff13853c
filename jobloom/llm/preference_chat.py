"""Preference pairs from conversations: one prompt, two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.llm.spread import small
from jobloom.operators.ranking import global_row_number

TURNS = "array<struct<role:string,text:string>>"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) without rows that lack a conv_id; null roles and texts are empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return conversations.select("conv_id", "turn", text("role"), text("text")).filter("conv_id IS NOT NULL")


def paired(rows: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id): conversations two by two, those of equal openings together.

    The order is that of the first turn's role, the MD5 sum of its text, and then of MD5 sums of the
    conv_ids: so conversations with the same first turn stand side by side, and what is left over
    of them meets others of the same role, whatever prefix they share. The first and second
    are a pair, the third and fourth, and so on. The one with more assistant characters is chosen, at a
    tie the first. Of an odd number the last has a null rejected_id. Conversations are numbered
    by ranges of that order, so no task sees all of an opening.
    """
    said = F.when(F.col("role") == "assistant", F.length("text")).otherwise(0)
    one = rows.distinct().groupBy("conv_id").agg(F.min(F.struct("turn", "role", "text")).alias("first"), F.sum(said).alias("said"))
    one = one.select("conv_id", "said", F.col("first.role").alias("role"), F.md5("first.text").alias("opening"),
                     F.substring(F.md5(F.col("conv_id").cast("string")), 1, 8).alias("part"))
    placed = global_row_number(one, ["role", "opening", "part", "conv_id"], "place")
    sides = placed.select(F.floor((F.col("place") - 1) / 2).alias("pair"), (-F.col("said")).alias("less"), "place", "conv_id")
    both = sides.groupBy("pair").agg(
        F.min(F.struct("less", "place", "conv_id"))["conv_id"].alias("chosen_id"),
        F.max(F.struct("less", "place", "conv_id"))["conv_id"].alias("last"), F.count("*").alias("n"))
    return both.select("chosen_id", F.when(F.col("n") == 2, F.col("last")).alias("rejected_id"))


def rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("<|end|>\n"))


def text_of(some: Column) -> Column:
    return F.array_join(F.transform(some, rendered), "")


def mask_of(some: Column) -> Column:
    """Spans (code points, end exclusive) of what assistants say, end mark included."""
    start = F.expr("named_struct('at', 0, 'spans', CAST(array() AS array<struct<start:int,end:int>>))")

    def step(done: Column, turn: Column) -> Column:
        end = done["at"] + F.length(rendered(turn))
        span = F.struct((done["at"] + F.length(turn["role"]) + 5).alias("start"), end.alias("end"))
        spans = F.when(turn["role"] == "assistant", F.concat(done["spans"], F.array(span))).otherwise(done["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(some, start, step)["spans"]


def formatted(conversations: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """One row per pair: (chosen_id, rejected_id, n_prompt_turns, prompt, chosen, rejected,
    chosen_mask, rejected_mask).

    ``pairs`` (chosen_id, rejected_id) names the pairs; by default ``paired`` makes them. The
    prompt is the longest common prefix of turns, equal in role and text. The completions are
    the rest of each side, and their masks the spans to train on. Two equal conversations share
    all turns, so both completions are empty. Without a rejected side the prompt is what comes
    before the last assistant turn (all, if there is none), and ``rejected`` and its mask are null.

    Turns go by number, nulls first, then role and text; repeated rows count once. Rows without
    a conv_id are left out; so are other columns. Texts are grouped once, by pair.
    """
    rows = turns(conversations)
    pairs, _ = small((paired(rows) if pairs is None else pairs).select("chosen_id", "rejected_id"), "preference-pairs")
    sides = pairs.select("chosen_id", "rejected_id", F.explode(F.filter(F.array(
        F.struct(F.col("chosen_id").alias("id"), F.lit(True).alias("picked")),
        F.struct(F.col("rejected_id").alias("id"), F.lit(False).alias("picked"))), lambda s: s["id"].isNotNull())).alias("side"))
    sides, _ = small(sides.select("chosen_id", "rejected_id", "side.*"), "preference-sides", 32)
    held = rows.join(sides, rows["conv_id"] == sides["id"]).groupBy("chosen_id", "rejected_id").agg(
        F.array_sort(F.collect_set(F.struct("picked", "turn", "role", "text"))).alias("all"))
    side = lambda picked: F.transform(F.filter("all", lambda t: t["picked"] == F.lit(picked)), lambda t: F.struct(t["role"], t["text"])).cast(TURNS)
    held = held.select("chosen_id", "rejected_id", side(True).alias("c"), side(False).alias("r"))
    same = F.zip_with("c", "r", lambda a, b: a.eqNullSafe(b))
    shared = F.when(F.forall(same, lambda x: x), F.size("c")).otherwise(F.array_position(same, F.lit(False)) - 1)
    answers = F.transform("c", lambda t: t["role"] == "assistant")
    alone = F.when(F.array_contains(answers, F.lit(True)), F.size("c") - F.array_position(F.reverse(answers), F.lit(True))).otherwise(F.size("c"))
    two = F.col("rejected_id").isNotNull()
    held = held.withColumn("n_prompt_turns", F.when(two, shared).otherwise(alone).cast("int"))
    rest = lambda c: F.slice(c, F.col("n_prompt_turns") + 1, F.size(c))
    held = held.select("chosen_id", "rejected_id", "n_prompt_turns", F.slice("c", F.lit(1), F.col("n_prompt_turns")).alias("p"),
                       rest("c").alias("c"), F.when(two, rest("r")).alias("r"))
    return held.select(
        "chosen_id", "rejected_id", "n_prompt_turns", text_of(F.col("p")).alias("prompt"),
        text_of(F.col("c")).alias("chosen"), F.when(two, text_of(F.col("r"))).alias("rejected"),
        mask_of(F.col("c")).alias("chosen_mask"), F.when(two, mask_of(F.col("r"))).alias("rejected_mask"))
