"""Shards by a weighted hash tree of regions, racks and shards; DataFrame functions only.

Every shard draws -ln(u) / weight for a document, u being a hash of shard and doc_id. A
rack's draw is the least of its shards' and a region's the least of its racks', which
makes each the draw of a node with the summed weight. A document descends to the region,
then the rack, then the shard of least draw. Draws of unchanged shards do not change, so
a heavier or new shard only takes documents into itself, a lighter one only gives some
up, and no document moves between subtrees whose weights stay.

The law that holds is `key`: doc_id and the number of shards decide. A null doc_id is a
key of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

SHARDS_PER_RACK = 5
RACKS_PER_REGION = 2
#: A shard's slots are numbered in so many independent parts.
SLOT_PARTS = 64


def tree_of(shards: int, per_rack: int = SHARDS_PER_RACK, racks: int = RACKS_PER_REGION) -> list[list[list[int]]]:
    """Regions of racks of shard numbers 0 .. shards - 1."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    all_racks = [list(range(i, min(i + per_rack, shards))) for i in range(0, shards, per_rack)]
    return [all_racks[i : i + racks] for i in range(0, len(all_racks), racks)]


def draw(key: Column, shard: int, weight: float) -> Column:
    """An exponential draw of rate weight, by key and shard."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(float(weight))


def least_of(nodes: list[Column]) -> Column:
    return nodes[0] if len(nodes) == 1 else F.least(*nodes)


def shard_of(key: Column, tree: list[list[list[int]]], weights: dict[int, float] | None = None) -> Column:
    """struct(draw, region, rack, shard) that the key descends to. Weights are 1 unless given; a weight of 0 takes nothing."""
    weights = weights or {}
    key = F.coalesce(key.cast("string"), F.lit("\x00null"))
    regions = []
    for region, racks in enumerate(tree):
        nodes = []
        for rack, shards in enumerate(racks):
            leaves = [F.struct(draw(key, s, weights.get(s, 1.0)).alias("draw"), F.lit(region).alias("region"), F.lit(rack).alias("rack"), F.lit(s).alias("shard")) for s in shards if weights.get(s, 1.0) > 0]
            if leaves:
                nodes.append(least_of(leaves))
        if nodes:
            regions.append(least_of(nodes))
    if not regions:
        raise ValueError("all weights are 0")
    return least_of(regions)


def text_size(text: Column) -> Column:
    """UTF-8 bytes (null: none) plus 16."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(16)).cast("long")


def sharded(docs: DataFrame, shards: int, grown: int | None = None, weights: dict[int, float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, region, rack of every row.

    Slots of a shard are 0, 1, 2 .. without a gap: its rows are dealt by a hash of the
    key into parts, numbered by doc_id (then size and checksum) within a part, and a
    part begins where the parts before it end.
    """
    placed = docs.select(
        "doc_id",
        text_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        shard_of(F.col("doc_id"), tree_of(shards), weights).alias("at"),
        (shard_of(F.col("doc_id"), tree_of(grown), weights)["shard"] if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.pmod(F.xxhash64("doc_id", F.lit("slot")), F.lit(SLOT_PARTS)).cast("int").alias("part"),
    ).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("at.shard").alias("shard"), "grown_shard", F.col("at.region").alias("region"), F.col("at.rack").alias("rack"), "part")
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # at most shards * SLOT_PARTS rows, however many documents
    starts = F.broadcast(counts.select("shard", "part", before.alias("start")))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32")) - 1
    return placed.join(starts, ["shard", "part"]).select("doc_id", "size", "text_crc32", "law", "shard", (F.col("start") + within).cast("long").alias("slot"), "grown_shard", "region", "rack")
