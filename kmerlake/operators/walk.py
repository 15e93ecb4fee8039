"""Walks over whole k-mer tables: accepted extensions, reachability, thresholds, error rates.

Whether an extension is accepted depends on the four siblings that share k - 1 bases and
not on where a walk came from. So acceptance is a window over the k-mer table, and a walk
is reachability over accepted k-mers; it finds the nodes of the depth-first walk wherever
none of that walk's limits binds.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import storage
from ..functions import kmers as K
from . import kmer_tables
from .local import TIERS


def siblings(direction: str) -> Column:
    """What siblings share: the first k - 1 bases going forward, the last going backward."""
    return K.prefix("kmer") if direction == "forward" else K.suffix("kmer")


def extensions(kmers: DataFrame, direction: str = "forward", count: int = 2, ratio: float = 0.05, by: list[str] = ("sample",)) -> DataFrame:
    """kmers with `total` of the siblings and `accepted`; count 1 at least."""
    over = Window.partitionBy(*by, siblings(direction))
    bar = F.greatest(F.lit(max(1, count)).cast("long"), (F.col("total") * F.lit(float(ratio))).cast("long"))
    return kmers.withColumn("total", F.sum("count").over(over)).withColumn("accepted", F.col("count") >= bar)


def reach_by_joins(targets: DataFrame, kmers: DataFrame, k: int, direction: str = "forward", count: int = 2, ratio: float = 0.05, hops: int = 6, keep_siblings: bool = False) -> DataFrame:
    """`reach` in one direction, with tables of any size.

    One loop serves all samples and targets. A round goes `hops` steps ahead and ends in a
    checkpoint; rounds go on until no new node appears. keep_siblings adds the extensions
    that were seen but not accepted, which thresholds and error rates are computed from.
    """
    ext = storage.checkpointed(extensions(kmers, direction, count, ratio).select("sample", siblings(direction).alias("_from"), F.col("kmer").alias("_next"), F.col("count").alias("_count"), "accepted"))
    taken = ext.filter("accepted")
    own = kmer_tables.target_kmers(targets, k).select("target", "kmer").distinct()
    samples = kmers.select("sample").distinct()
    reference = storage.checkpointed(kmer_tables.lookup(own.join(samples, F.lit(True)), kmers, ["sample", "kmer"]).select("sample", "target", "kmer", "count", F.lit(True).alias("is_reference")))
    towards = K.suffix("kmer") if direction == "forward" else K.prefix("kmer")

    def step(frontier: DataFrame, edges: DataFrame) -> DataFrame:
        near = frontier.select("sample", "target", towards.alias("_from")).distinct()
        return near.join(edges, ["sample", "_from"]).select("sample", "target", F.col("_next").alias("kmer"), F.col("_count").alias("count"))

    visited = frontier = reference
    keys = ["sample", "target", "kmer"]
    while not frontier.isEmpty():
        found = ahead = step(frontier, taken)
        for _ in range(hops - 1):
            ahead = step(ahead, taken)
            found = found.union(ahead)
        frontier = storage.checkpointed(found.distinct().join(visited, keys, "left_anti").withColumn("is_reference", F.lit(False)))
        visited = storage.checkpointed(visited.union(frontier))
    if keep_siblings:
        seen = step(visited, ext).distinct().join(visited, keys, "left_anti").withColumn("is_reference", F.lit(False))
        visited = visited.union(seen)
    return visited


#: Samples of up to so many accepted k-mers are walked in tasks that hold these; larger ones by joins. A task's memory was not measured at this limit.
HELD = 4_000_000
#: Walks that a task makes, one after another.
WALKS = 20


class Ways:
    """A sample's accepted k-mers, ascending, and for each direction where a walk goes on from any k - 1 bases."""

    def __init__(self, rows: pa.Table, k: int, directions: list[str]):
        rows = rows.sort_by("kmer").combine_chunks()
        self.k, self.count = k, rows["count"].to_numpy()
        self.names = rows["kmer"].combine_chunks() if isinstance(rows["kmer"], pa.ChunkedArray) else rows["kmer"]
        flat = np.array(self.names.cast(pa.binary()).to_pylist(), dtype=f"S{k}")
        self.kmers = flat
        letters = flat.view(np.uint8).reshape(len(flat), k)
        ends = {"prefix": np.ascontiguousarray(letters[:, :-1]).view(f"S{k - 1}").ravel(), "suffix": np.ascontiguousarray(letters[:, 1:]).view(f"S{k - 1}").ravel()}
        self.ways = {}
        for direction in directions:
            shared, towards = ("prefix", "suffix") if direction == "forward" else ("suffix", "prefix")
            order = np.flatnonzero(rows[direction].to_numpy(zero_copy_only=False))
            order = order[np.argsort(ends[shared][order], kind="stable")]
            keys = ends[shared][order]
            self.ways[direction] = keys, order, np.searchsorted(keys, ends[towards], "left"), np.searchsorted(keys, ends[towards], "right")

    def reached(self, own: list[str]) -> np.ndarray:
        """Places of all k-mers that walks from own k-mers reach in any direction; own ones are left out."""
        found = np.zeros(len(self.kmers), dtype=bool)
        mine = np.array([x.encode() for x in own])
        place = np.minimum(np.searchsorted(self.kmers, mine), max(len(self.kmers) - 1, 0))
        place = place[self.kmers[place] == mine] if len(self.kmers) else place[:0]
        for direction, (keys, order, low, high) in self.ways.items():
            seen = np.zeros(len(self.kmers), dtype=bool)
            seen[place] = True
            start = np.array([(x[1:] if direction == "forward" else x[:-1]).encode() for x in own])
            begin, end = np.searchsorted(keys, start, "left"), np.searchsorted(keys, start, "right")
            while len(begin):
                n = end - begin
                first = np.cumsum(n) - n
                ahead = order[np.repeat(begin - first, n) + np.arange(n.sum())]
                ahead = np.unique(ahead[~seen[ahead]])
                seen[ahead] = True
                found[ahead] = True
                begin, end = low[ahead], high[ahead]
        found[place] = False
        return np.flatnonzero(found)


def reach(targets: DataFrame, kmers: DataFrame, k: int, direction: str | None = "forward", count: int = 2, ratio: float = 0.05, hops: int = 6, keep_siblings: bool = False) -> DataFrame:
    """sample, target, kmer, count, is_reference of all nodes that walks of all targets reach; direction None for both.

    A sample's accepted k-mers are written to a file in the shared folder; a task loads
    them once and makes the walks of some targets, so nothing is moved at each step.
    Samples of more than HELD accepted k-mers, or with k-mers of other lengths or
    letters, go by joins, and so does keep_siblings, which adds the extensions that were
    seen but not accepted, which thresholds and error rates are computed from.
    """
    directions = [direction] if direction else ["forward", "backward"]
    options = dict(count=count, ratio=ratio, hops=hops, keep_siblings=keep_siblings)
    folder = storage.new_folder(kmers.sparkSession, "reach")
    kmers = storage.written(kmers.select("sample", "kmer", "count"), f"{folder}/kmers")  # counting is not done twice

    def by_joins(kmers: DataFrame) -> DataFrame:
        if direction:
            return reach_by_joins(targets, kmers, k, direction, **options)
        both = reach_by_joins(targets, kmers, k, "forward", **options).union(reach_by_joins(targets, kmers, k, "backward", **options))
        return both.groupBy("sample", "target", "kmer").agg(F.max("count").alias("count"), F.max("is_reference").alias("is_reference"))

    if keep_siblings:
        return by_joins(kmers)
    taken = kmers
    for way in directions:
        taken = extensions(taken, way, count, ratio).drop("total").withColumnRenamed("accepted", way)
    taken = storage.written(taken.filter(" or ".join(directions)), f"{folder}/taken")
    odd = F.max((F.length("kmer") != k) | ~K.is_dna("kmer"))
    sizes = storage.written(taken.groupBy("sample").agg(F.count("*").alias("_n"), odd.alias("_odd")), f"{folder}/sizes")
    large = sizes.filter((F.col("_n") > HELD) | F.col("_odd")).select("sample")

    def pack(key, rows):
        file = f"{folder}/ways/{uuid.uuid4().hex}"
        system, where = storage.file_system(file)
        system.create_dir(where.rsplit("/", 1)[0], recursive=True)
        rows = rows.select(["kmer", "count", *directions])
        with system.open_output_stream(where) as out, pa.ipc.new_stream(out, rows.schema) as sink:
            sink.write_table(rows)
        return pa.table({"sample": [key[0].as_py()], "file": [file]})

    kind, name = (x.schema[c].dataType.simpleString() for x, c in ((kmers, "sample"), (targets, "target")))
    files = taken.join(large, "sample", "left_anti").filter("sample is not null").groupBy("sample").applyInArrow(pack, f"sample {kind}, file string")
    files = storage.written(files, f"{folder}/files")
    own = kmer_tables.target_kmers(targets, k).select("target", "kmer").distinct()
    samples = kmers.select("sample").distinct()
    reference = kmer_tables.lookup(own.join(samples, F.lit(True)), kmers, ["sample", "kmer"])
    jobs = reference.groupBy("sample", "target").agg(F.collect_list("kmer").alias("kmers"), F.collect_list("count").alias("counts"))
    jobs = storage.written(jobs.join(large, "sample", "left_anti").join(files, "sample", "left"), f"{folder}/jobs")

    def walk(batches):
        names = ["sample", "target", "kmer", "count", "is_reference"]
        held = ways = None
        for batch in batches:
            for sample, target, mine, counts, file in zip(*batch.columns):
                mine, counts, file = mine.as_py(), counts.as_py(), file.as_py()
                yield pa.RecordBatch.from_arrays([pa.repeat(sample, len(mine)), pa.repeat(target, len(mine)), pa.array(mine, pa.string()), pa.array(counts, pa.int64()), pa.repeat(pa.scalar(True), len(mine))], names=names)
                if file is None:
                    continue
                if file != held:
                    ways = None
                    system, where = storage.file_system(file)
                    with system.open_input_stream(where) as source, pa.ipc.open_stream(source) as rows:
                        held, ways = file, Ways(rows.read_all(), k, directions)
                found = ways.reached(mine)
                for i in range(0, len(found), 1 << 16):
                    some = found[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.repeat(sample, len(some)), pa.repeat(target, len(some)), ways.names.take(pa.array(some)), pa.array(ways.count[some]), pa.repeat(pa.scalar(False), len(some))], names=names)

    parts = max(1, -(-jobs.count() // WALKS))
    out = jobs.select("sample", "target", "kmers", "counts", "file").repartitionByRange(parts, "sample", "target").mapInArrow(walk, f"sample {kind}, target {name}, kmer string, count long, is_reference boolean")
    return out if large.isEmpty() else out.union(by_joins(kmers.join(large, "sample", "left_semi")))


def reach_both(targets: DataFrame, kmers: DataFrame, k: int, **options) -> DataFrame:
    """Union of a forward and an independent backward walk."""
    return reach(targets, kmers, k, None, **options)


def extension_sums(rows: DataFrame, kmers: DataFrame, by: list[str]) -> DataFrame:
    """rows (with kmer) with `ext_sum` and `ext_max` over the four right extensions."""
    groups = kmers.groupBy(*by, K.prefix("kmer").alias("_from")).agg(F.sum("count").alias("ext_sum"), F.max("count").alias("ext_max"))
    out = rows.withColumn("_from", K.suffix("kmer")).join(groups, [*by, "_from"], "left").drop("_from")
    return out.withColumns({x: F.coalesce(x, F.lit(0)).cast("long") for x in ("ext_sum", "ext_max")})


def error_rate_of_walk(reference: DataFrame, kmers: DataFrame, by: list[str], group: list[str]) -> DataFrame:
    """group, error_rate: extensions other than the largest, over three times the reference counts.

    reference holds kmer and count; k-mers that do not occur are left out.
    """
    rows = extension_sums(reference.filter("count > 0"), kmers, by)
    total = F.sum("count")
    return rows.groupBy(*group).agg((F.sum(F.col("ext_sum") - F.col("ext_max")) / (F.lit(3.0) * total)).alias("error_rate"))


def error_rate_of_extensions(reference: DataFrame, kmers: DataFrame, by: list[str], group: list[str], least: int = 10, default: float = 0.001) -> DataFrame:
    """group, error_rate: extensions other than the reference's next k-mer over all; reference holds pos and kmer."""
    over = Window.partitionBy(*group).orderBy("pos")
    pairs = reference.withColumn("_next", F.lead("kmer").over(over)).filter("_next is not null")
    rows = extension_sums(pairs, kmers, by).filter("ext_sum > 0")
    right = kmers.select(*by, F.col("kmer").alias("_right"), F.col("count").alias("_good"))
    goes_on = F.concat(K.suffix("kmer"), F.right("_next", F.lit(1)))
    rows = rows.withColumn("_right", goes_on).join(right, [*by, "_right"], "left")
    found = rows.groupBy(*group).agg(F.count("*").alias("n"), F.sum(F.col("ext_sum") - F.coalesce("_good", F.lit(0))).alias("wrong"), F.sum("ext_sum").alias("total"))
    rate = F.when(F.col("n") < least, F.lit(default)).otherwise(F.least(F.lit(0.1), F.greatest(F.lit(1e-6), F.col("wrong") / F.col("total"))))
    return reference.select(*group).distinct().join(found.select(*group, rate.alias("error_rate")), group, "left").withColumn("error_rate", F.coalesce("error_rate", F.lit(default)))


def tier(median: Column) -> Column:
    out = F.when(F.floor(median) < TIERS[0][0], TIERS[0][1])
    for bar, name, _ in TIERS[1:-1]:
        out = out.when(F.floor(median) < bar, name)
    return out.otherwise(TIERS[-1][1])


def adaptive_thresholds(reference: DataFrame, kmers: DataFrame, by: list[str], group: list[str], order: list[str], sample: int = 100, default_error: float = 0.001) -> DataFrame:
    """group, median_coverage, error_rate, tier, count_threshold, ratio_threshold from at most `sample` reference k-mers."""
    taken = kmer_tables.every_nth(reference, group, order, sample)
    counted = kmer_tables.lookup(taken, kmers, [*by, "kmer"])
    medians = counted.groupBy(*group).agg(F.percentile("count", F.lit(0.5)).alias("median_coverage"))
    rates = error_rate_of_walk(counted, kmers, by, group)
    out = medians.join(rates, group, "left")
    out = out.withColumn("error_rate", F.when(F.coalesce("error_rate", F.lit(0.0)) > 0, F.col("error_rate")).otherwise(F.lit(default_error)))
    expected = F.col("median_coverage") * F.col("error_rate")
    ratio = F.create_map(*[x for _, name, r in TIERS for x in (F.lit(name), F.lit(r))])
    return out.withColumn("tier", tier(F.col("median_coverage"))).withColumns(
        {
            "count_threshold": F.greatest(F.lit(2), F.ceil(expected + F.lit(2.33) * F.sqrt(expected)).cast("int")),
            "ratio_threshold": F.element_at(ratio, F.col("tier")),
        }
    )
