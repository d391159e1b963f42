"""Logged conversations: collapse of cumulative snapshots, and rendering, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stylematch.session import stage

#: Turn numbers per part: a long conversation is numbered, hashed and rendered by parts.
PART = 256
_NONE = -(1 << 63)


def _turns(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(
        F.coalesce(conversations["conv_id"].cast("long"), F.lit(_NONE)).alias("conv"), F.coalesce(conversations["turn"].cast("long"), F.lit(_NONE)).alias("turn"),
        F.coalesce(conversations["role"].cast("string"), F.lit("")).alias("role"), F.coalesce(conversations["text"].cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("part", F.expr(f"turn div {PART}"))


def _before(rows: DataFrame, value: Column, out: str) -> DataFrame:
    """(conv, part, out): the running value of the earlier parts of each conversation."""
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("conv", "part", F.coalesce(value.over(earlier), F.lit(0)).alias(out))


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """(conv, n_turns, copies): the conversations that no other one continues; equal ones once, by their least id.

    See ``collapse_and_render``. ``conv`` is the id, with the least long for null.
    """
    rows = _turns(conversations).select("conv", "part", "turn", "role", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "role").alias("h2"))
    rows = stage(rows.distinct(), "turns")
    in_part = Window.partitionBy("conv", "part").orderBy("turn", "role", "h1", "h2")
    counts = _before(rows.groupBy("conv", "part").agg(F.count("*").alias("n")), F.sum("n"), "before")
    placed = rows.withColumn("at", F.row_number().over(in_part)).join(counts, ["conv", "part"]).withColumn("place", F.col("at") + F.col("before"))
    placed = placed.select("conv", "part", "place", F.xxhash64("place", "h1", "h2").alias("x1"), F.xxhash64("h2", "place", "h1").alias("x2"))
    placed = stage(placed, "placed")
    totals = placed.groupBy("conv", "part").agg(F.bit_xor("x1").alias("t1"), F.bit_xor("x2").alias("t2"))
    above = _before(totals, F.bit_xor("t1"), "b1").join(_before(totals, F.bit_xor("t2"), "b2"), ["conv", "part"])
    running = Window.partitionBy("conv", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rolled = placed.select("conv", "part", "place", F.bit_xor("x1").over(running).alias("r1"), F.bit_xor("x2").over(running).alias("r2")).join(above, ["conv", "part"])
    prefixes = rolled.select("conv", "place", F.col("r1").bitwiseXOR(F.col("b1")).alias("p1"), F.col("r2").bitwiseXOR(F.col("b2")).alias("p2"))

    whole = placed.groupBy("conv").agg(F.count("*").alias("n_turns"), F.bit_xor("x1").alias("p1"), F.bit_xor("x2").alias("p2"))
    distinct = whole.groupBy("n_turns", "p1", "p2").agg(F.min("conv").alias("conv"), F.count("*").alias("copies"))
    inner = prefixes.join(whole.select("conv", "n_turns"), "conv").filter("place < n_turns").select(F.col("place").alias("n_turns"), "p1", "p2").distinct()
    return distinct.join(inner, ["n_turns", "p1", "p2"], "left_anti").select("conv", "n_turns", "copies")


def collapse_and_render(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, copies, text): the maximal conversations, rendered as ``<|role|>`` blocks.

    A log holds a conversation again after every turn. A conversation goes if its turns are the first turns of a longer
    one; of equal conversations the least id stays and ``copies`` counts them. Each prefix has a rolling 128-bit hash,
    the exclusive or of hashes of (place, role, text); an anti-join of whole hashes with the proper prefixes keeps the
    maximal conversations. The place of a turn is its rank by turn, role and text (by hash where they differ in text
    alone), so gaps and other first numbers do not matter.

    Rows that repeat all of conv_id, turn, role and text count once. A null conv_id is a conversation of its own (with a
    null id), a null turn comes first, a null role or text is empty. An empty table gives an empty result. Other columns
    are not read. A conversation is cut into parts of 256 turn numbers, each rendered to a row of its own, so none has
    to fit into one task; nearly all have the single part 0.
    """
    kept = stage(maximal_conversations(conversations), "maximal")
    turns = _turns(conversations).join(kept, "conv")
    block = F.array_sort(F.collect_set(F.struct("turn", "role", "text")))
    rendered = turns.groupBy("conv", "part", "n_turns", "copies").agg(block.alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("\n<|end|>\n"))), "")
    return rendered.select(F.when(F.col("conv") != _NONE, F.col("conv")).alias("conv_id"), "part", "n_turns", "copies", text.alias("text"))
