"""Chat formatting after collapsing cumulative snapshots; DataFrame functions only.

A log often holds a conversation again and again as it grows. Turns are ordered by their
number (ties by role and text, beyond its first HEAD characters by hashes, so repeated rows
are turns of their own). Role and text are hashed where they are read; only hashes and heads
are moved to find what stays, and whole texts once, for what stays. Each turn has a
hash of its place, role and text; the running sum of two such 64-bit hashes is the hash
of the prefix that ends there. A conversation whose whole hash is the hash of a shorter
prefix of another one is a snapshot of it; an anti-join on prefix hashes keeps maximal
conversations. Of conversations with equal turns the one with the smallest conv_id stays.

Rendering: `<|im_start|>role`, a line feed, the text, `<|im_end|>`, a line feed, for each
turn. The markers inside a text are escaped by a backslash after `<`, so that no text can
open or close a turn. A null role is `unknown`, a null text is empty. A null conv_id is
one conversation. Turns with a null number come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Turns of a conversation are numbered and summed in stretches of so many turn numbers.
STRETCH = 512
HEAD = 64


def turn_text(role: Column, text: Column) -> Column:
    safe = F.regexp_replace(text, "<(?=\\|im_(start|end)\\|>)", "<\\\\")
    return F.concat(F.lit(OPEN), role, F.lit("\n"), safe, F.lit(CLOSE + "\n"))


def prefixes(conversations: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """conv_id, place (from 1), n_turns, h1, h2 (hashes of the prefix up to here).

    Places and sums are taken within stretches of turns first and then over stretches,
    so one task orders at most one stretch of a conversation, however long.
    """
    role, text = F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit(""))
    own = [F.xxhash64(F.lit(seed), role, text).alias(f"k{i}") for i, seed in ((1, 11), (2, 1000003))]
    turns = conversations.select(F.struct("conv_id").alias("c"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.left(text, F.lit(HEAD)).alias("head"), *own)
    turns = turns.withColumn("part", F.coalesce(F.floor(F.col("turn") / stretch), F.lit(-(1 << 62))).cast("long"))
    order = Window.partitionBy("c", "part").orderBy(F.asc_nulls_first("turn"), "role", "head", "k1", "k2")
    parts = turns.groupBy("c", "part").agg(F.count("*").alias("n"))
    over = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("c", "part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("c")).alias("n_turns"))
    numbered = turns.withColumn("within", F.row_number().over(order)).select("c", "part", "within", "k1", "k2").join(parts, ["c", "part"])
    place = F.col("before") + F.col("within")
    hashes = [F.xxhash64(F.lit(i), place, "k1", "k2").cast("decimal(38,0)").alias(f"t{i}") for i in (1, 2)]
    hashed = numbered.select("c", "part", place.alias("place"), "n_turns", *hashes)
    run = Window.partitionBy("c", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    sums = hashed.groupBy("c", "part").agg(F.sum("t1").alias("s1"), F.sum("t2").alias("s2"))
    sums = sums.select("c", "part", *[F.coalesce(F.sum(f"s{i}").over(over), F.lit(0)).alias(f"b{i}") for i in (1, 2)])
    out = hashed.select("*", F.sum("t1").over(run).alias("r1"), F.sum("t2").over(run).alias("r2")).join(sums, ["c", "part"])
    return out.select(F.col("c.conv_id").alias("conv_id"), "place", "n_turns", *[(F.col(f"b{i}") + F.col(f"r{i}")).cast("decimal(38,0)").alias(f"h{i}") for i in (1, 2)])


def maximal(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies (conversations with the same turns) of those that stay."""
    found = prefixes(conversations).select("conv_id", "place", "n_turns", "h1", "h2")
    whole = found.filter("place = n_turns").groupBy("h1", "h2", "n_turns").agg(F.min(F.struct(F.col("conv_id").isNotNull().alias("z"), "conv_id")).alias("least"), F.count("*").alias("n_copies"))
    shorter = found.filter("place < n_turns").select("h1", "h2", F.col("place").alias("n_turns")).distinct()
    return whole.join(shorter, ["h1", "h2", "n_turns"], "left_anti").select(F.col("least.conv_id").alias("conv_id"), "n_turns", "n_copies")


def rendered(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, text: one row for each maximal conversation."""
    stay = maximal(conversations)
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    mine = turns.join(stay.select(F.col("conv_id").alias("stay_id"), "n_turns", "n_copies"), F.col("conv_id").eqNullSafe(F.col("stay_id")))
    lines = mine.groupBy("conv_id", "n_turns", "n_copies").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(1 << 63))).alias("turn"), "role", "text"))).alias("turns"))
    return lines.select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("turns", lambda t: turn_text(t["role"], t["text"])), "").alias("text"))
