"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions alone.

A log that stores a conversation again after every turn holds many conversations that are prefixes of
longer ones. Each turn gets two 64-bit hashes of its position and content; their running XOR is the hash of
the conversation up to that turn. A conversation whose last hash is some longer conversation's prefix hash
is anti-joined away, of equal ones the smallest id stays, and only the rest is rendered. Running values
are taken in two steps, within and across runs of `part_turns` turn numbers, so a conversation that holds
much of the table is spread over tasks; it is rendered in as many parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import staged

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    r"""Markers in a text lose their force: one backslash more after `<` where `<|`, `<\|`, ... stands."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def _rows(turns: DataFrame, part_turns: int) -> DataFrame:
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turn = F.col("turn").cast("long")
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"),
        F.coalesce(F.floor(turn / part_turns), F.lit(2**62)).alias("run"),
        F.xxhash64(F.lit(1), role, F.lit("\x00"), text).alias("a"), F.xxhash64(F.lit(2), text, F.lit("\x00"), role).alias("b"),
    )


def prefix_hashes(turns: DataFrame, part_turns: int = 256) -> DataFrame:
    """conv_id, pos (from 1), n (turns of the conversation), ha, hb: hashes of the first pos turns."""
    within = Window.partitionBy("conv_id", "run").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    rows = staged(_rows(turns, part_turns).withColumn("rank", F.row_number().over(within)).drop("text", "role", "turn"), "turns")
    key = lambda x, y: x["conv_id"].eqNullSafe(y["c"]) & (x["run"] == y["r"])
    whole, before = Window.partitionBy("conv_id"), Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("conv_id", "run").agg(F.count("*").alias("k"))
    runs = runs.select(F.col("conv_id").alias("c"), F.col("run").alias("r"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("first"), F.sum("k").over(whole).alias("n"))
    placed = rows.join(runs, key(rows, runs)).withColumn("pos", F.col("first") + F.col("rank"))
    hashed = placed.select("conv_id", "run", "n", "pos", F.xxhash64(F.lit(3), "pos", "a").alias("a"), F.xxhash64(F.lit(4), "pos", "b").alias("b"))
    up_to = Window.partitionBy("conv_id", "run").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    running = staged(hashed.select("*", F.expr("bit_xor(a)").over(up_to).alias("xa"), F.expr("bit_xor(b)").over(up_to).alias("xb")), "running")
    sums = running.groupBy("conv_id", "run").agg(F.expr("bit_xor(a)").alias("sa"), F.expr("bit_xor(b)").alias("sb"))
    zero = F.lit(0).cast("long")
    sums = sums.select(F.col("conv_id").alias("c"), F.col("run").alias("r"), F.coalesce(F.expr("bit_xor(sa)").over(before), zero).alias("pa"), F.coalesce(F.expr("bit_xor(sb)").over(before), zero).alias("pb"))
    met = running.join(sums, key(running, sums))
    return met.select("conv_id", "pos", "n", F.col("xa").bitwiseXOR(F.col("pa")).alias("ha"), F.col("xb").bitwiseXOR(F.col("pb")).alias("hb"))


def maximal(turns: DataFrame, part_turns: int = 256) -> DataFrame:
    """conv_id of the conversations that are neither a prefix of a longer one nor equal to one of smaller id."""
    hashes = staged(prefix_hashes(turns, part_turns), "prefixes")
    ends = hashes.filter("pos = n").groupBy("pos", "ha", "hb").agg(F.min(F.struct(F.col("conv_id").isNull().alias("last"), "conv_id")).alias("k"))
    inner = hashes.filter("pos < n").select("pos", "ha", "hb").distinct()
    return ends.join(inner, ["pos", "ha", "hb"], "left_anti").select("k.conv_id")


def render(turns: DataFrame, part_turns: int = 256) -> DataFrame:
    """One row per conversation and run of part_turns turn numbers: conv_id, part, n_turns, rendered.

    Almost every conversation has one part; the parts of a longer one, joined in order, are its rendering.
    """
    rows = _rows(turns, part_turns)
    line = lambda x: F.concat(F.lit(START), escape(x["role"]), F.lit("\n"), escape(x["text"]), F.lit(END), F.lit("\n"))
    item = F.struct(F.col("turn").isNull().alias("u"), "turn", "role", "text")
    parts = rows.groupBy("conv_id", "run").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return parts.select("conv_id", F.col("run").cast("long").alias("part"), F.size("items").cast("long").alias("n_turns"), F.array_join(F.transform("items", line), "").alias("rendered"))


def format_chats(turns: DataFrame, part_turns: int = 256) -> DataFrame:
    """Maximal conversations, rendered: conv_id, part, n_turns, rendered.

    Turns go by turn number, null last, ties by role, then text; null role or text counts as empty; rows
    with a null conv_id are one conversation, whose id comes after all others; repeated rows are repeated
    turns; an empty table gives no rows; only the four columns named are read, so others cannot clash.
    """
    kept = maximal(turns, part_turns).select(F.col("conv_id").alias("c"))
    return render(turns.join(kept, F.col("conv_id").cast("long").eqNullSafe(F.col("c")), "left_semi"), part_turns)
