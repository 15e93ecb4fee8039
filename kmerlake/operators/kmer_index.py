"""K-mer tables as packed parts in shared storage, looked up by tasks.

A walk asks for the counts of k-mers one after another, and where it goes next depends on
the answers. So the table is dealt, by sample, into parts of about PART_ROWS k-mers, and a
task loads the parts that its walks come through. The part of a k-mer follows from its
minimizer, the least hash of its words of M bases: neighbours in a walk mostly share it,
so a walk stays in a part for many steps. A task holds CACHED parts at most, whatever the
table's size; no k-mer goes through the driver.
"""

from __future__ import annotations

import uuid
import zlib
from collections import OrderedDict
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .. import storage

M = 7
PART_ROWS = 200_000
CACHED = 16


def minimizer(kmer: Column, k: int) -> Column:
    m = min(M, k)
    return F.array_min(F.transform(F.sequence(F.lit(1), F.lit(k - m + 1)), lambda i: F.crc32(F.substring(kmer, i, F.lit(m)).cast("binary"))))


def minimizer_of(kmer: str, k: int) -> int:
    m, raw = min(M, k), kmer.encode()
    return min(zlib.crc32(raw[i : i + m]) for i in range(k - m + 1))


def built(kmers: DataFrame, k: int, part_rows: int = PART_ROWS) -> DataFrame:
    """sample, n_parts, parts array<struct<part, file>> of a table of sample, kmer, count; files lie in a new shared folder.

    A task writes a part under a name of its own attempt; the returned table, written
    once and read back, says which files count.
    """
    folder = storage.new_folder(kmers.sparkSession, "kmer-index")
    kmers = storage.written(kmers, f"{folder}/kmers")  # counting is not done twice
    sizes = kmers.groupBy("sample").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("n_parts"))
    sizes = storage.written(sizes, f"{folder}/sizes")
    dealt = kmers.join(sizes, "sample").withColumn("part", F.when(F.col("n_parts") == 1, 0).otherwise(F.pmod(minimizer(F.col("kmer"), k), F.col("n_parts"))).cast("int"))

    def pack(key, rows):
        target = f"{folder}/parts/{uuid.uuid4().hex}"
        system, where = storage.file_system(target)
        system.create_dir(where.rsplit("/", 1)[0], recursive=True)
        rows = rows.select(["kmer", "count"])
        with system.open_output_stream(where) as out, pa.ipc.new_stream(out, rows.schema) as sink:
            sink.write_table(rows)
        return pa.table({"sample": [key[0].as_py()], "part": pa.array([key[1].as_py()], pa.int32()), "file": [target]})

    parts = dealt.groupBy("sample", "part").applyInArrow(pack, "sample string, part int, file string")
    parts = storage.written(parts, f"{folder}/names")
    return parts.groupBy("sample").agg(F.collect_list(F.struct("part", "file")).alias("parts")).join(sizes, "sample")


class Parts:
    """Counts of one sample's k-mers, for a task."""

    def __init__(self, k: int, n_parts: int, files: dict[int, str], cached: int = CACHED):
        self.k, self.n, self.files, self.cached = k, n_parts, files, cached
        self.held: OrderedDict[int, dict[str, int]] = OrderedDict()

    def part(self, number: int) -> dict[str, int]:
        found = self.held.get(number)
        if found is None:
            found = {}
            if number in self.files:  # else no k-mer of the sample is of that part
                system, where = storage.file_system(self.files[number])
                with system.open_input_stream(where) as file, pa.ipc.open_stream(file) as rows:
                    for batch in rows:
                        found.update(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            self.held[number] = found
            if len(self.held) > self.cached:
                self.held.popitem(last=False)
        else:
            self.held.move_to_end(number)
        return found

    def lookup(self) -> Callable[[str], int]:
        """k-mer -> count, 0 where unknown."""
        if self.n == 1:
            whole = self.part(0)
            return lambda kmer: whole.get(kmer, 0)
        return lambda kmer: self.part(minimizer_of(kmer, self.k) % self.n).get(kmer, 0)
