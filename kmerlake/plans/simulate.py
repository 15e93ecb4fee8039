"""Simulated panels: targets, variants put into them, k-mer counts and the truth."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions import kmers as K
from ..operators import kmer_tables

#: Numbers of substitutions, insertions, deletions, duplications and absent controls; shares; coverage; k; target length; largest indel.
PRESETS = {
    "snv_indel": ((30, 15, 15, 5, 10), (0.001, 0.5), 3000, 31, 150, 4),
    "large_indels": ((0, 15, 15, 5, 5), (0.01, 0.2), 3000, 21, 200, 50),
    "ultra_low_vaf": ((30, 10, 10, 0, 10), (0.0001, 0.001), 5000, 31, 150, 4),
    "dilution_series": ((10, 5, 5, 0, 5), (0.0005, 0.10), 3000, 31, 150, 4),
}
KINDS = ("Substitution", "Insertion", "Deletion", "ITD", "absent")


@dataclass(frozen=True)
class Panel:
    targets: DataFrame
    kmers: DataFrame
    truth: DataFrame
    k: int


def simulate(spark: SparkSession, preset: str = "snv_indel", seed: int = 1, sample: str = "sim", poisson: bool = False) -> Panel:
    """A panel with one variant in the middle of each target. Counts are uniform between 0 and twice the mean, or Poisson; below 2 they are dropped."""
    sizes, (low, high), coverage, k, length, largest = PRESETS[preset]
    rng = np.random.default_rng(seed)
    dna = lambda n: "".join(rng.choice(list("ACGT"), n))
    targets, truth, counts = [], [], {}

    def add(sequence: str, mean: float) -> None:
        for i in range(len(sequence) - k + 1):
            n = rng.poisson(mean) if poisson else int(rng.uniform(0, 2 * mean))
            counts[sequence[i : i + k]] = counts.get(sequence[i : i + k], 0) + int(n)

    for kind, number in zip(KINDS, sizes):
        for _ in range(number):
            name, sequence, at = f"T{len(targets):03d}_{kind}", dna(length), length // 2
            n = int(rng.integers(2 if kind == "ITD" else 1, largest + 1)) if largest > 1 else 1
            share = float(np.exp(rng.uniform(np.log(low), np.log(high)))) if kind != "absent" else 0.0
            base = sequence[at]
            old, new = base, str(rng.choice([b for b in "ACGT" if b != base]))
            if kind == "Insertion":
                old, new = base, base + dna(n)
            elif kind == "Deletion":
                old, new = sequence[at : at + 1 + n], base
            elif kind == "ITD":
                old, new = base, base + sequence[at + 1 - n : at + 1]
            add(sequence, coverage * (1 - share))
            if share:
                add(sequence[:at] + new + sequence[at + len(old) :], coverage * share)
            targets.append((name, sequence, preset))
            truth.append(("chr1", 1000 * len(targets) + at, old, new, "Substitution" if kind == "absent" else kind, share, kind))
    rows = [(sample, k, x, n) for x, n in counts.items() if n >= 2]
    return Panel(spark.createDataFrame(targets, schemas.TARGETS), spark.createDataFrame(rows, schemas.KMERS), spark.createDataFrame(truth, schemas.TRUTH), k)


def read_counts(haplotypes: DataFrame, k: int, coverage: float, read_length: int = 150, seed: int = 1, sample: str = "sim", min_count: int = 2) -> DataFrame:
    """A canonical k-mer table counted from simulated reads of haplotypes (target, sequence, share).

    A haplotype has as many reads as its share of the coverage needs, one at least, from
    hashed starts and strands, so results do not depend on partitions. A sequence shorter
    than a read is one read.
    """
    size, length = F.length("sequence"), F.lit(read_length)
    reads = F.when(size < length, 1).otherwise(F.greatest(F.lit(1), F.ceil(F.lit(float(coverage)) * F.col("share") * size / length)))
    numbered = haplotypes.withColumn("read", F.explode(F.sequence(F.lit(1).cast("long"), reads.cast("long"))))
    draw = lambda what: F.xxhash64(F.lit(seed), F.lit(what), "target", "sequence", "read")
    start = F.pmod(draw("start"), F.greatest(size - length + 1, F.lit(1)))
    read = F.substring(F.col("sequence"), start.cast("int") + 1, length)
    stranded = F.when(F.pmod(draw("strand"), F.lit(2)) == 0, read).otherwise(K.reverse_complement(read))
    counts = kmer_tables.count_kmers(numbered.select(F.lit(sample).alias("sample"), stranded.alias("sequence")), k, canonical=True, min_count=min_count)
    return counts.select("sample", "k", "kmer", "count")
