"""K-mer functions over columns; strings are the main form, packed longs serve k <= 31."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_dna(x: Column | str) -> Column:
    return F.coalesce(col(x).rlike("^[ACGTacgt]+$"), F.lit(False))


def encode_base(x: Column | str) -> Column:
    """0 to 3 for A, C, G, T in either case; null otherwise."""
    x = F.upper(col(x))
    return F.when(x.isin("A", "C", "G", "T"), F.translate(x, "ACGT", "0123").cast("int"))


def decode_base(x: Column | str) -> Column:
    return F.substring(F.lit("ACGT"), (col(x) + 1).cast("int"), F.lit(1))


def encode(kmer: Column | str) -> Column:
    """A k-mer of 31 bases at most as a long, two bits a base; null for anything else."""
    x = col(kmer)
    packed = F.conv(F.translate(F.upper(x), "ACGT", "0123"), 4, 10).cast("long")
    return F.when(is_dna(x) & (F.length(x) <= 31), packed)


def decode(packed: Column | str, k: Column | int) -> Column:
    k = F.lit(k) if isinstance(k, int) else k
    digits = F.conv(col(packed).cast("string"), 10, 4)
    return F.translate(F.lpad(digits, k, F.lit("0")), "0123", "ACGT")


def reverse_complement(kmer: Column | str) -> Column:
    return F.reverse(F.translate(col(kmer), "ACGTacgt", "TGCAtgca"))


def canonical(kmer: Column | str) -> Column:
    return F.least(col(kmer), reverse_complement(kmer))


def prefix(kmer: Column | str) -> Column:
    return F.left(col(kmer), F.length(col(kmer)) - 1)


def suffix(kmer: Column | str) -> Column:
    return F.substring(col(kmer), F.lit(2), F.length(col(kmer)))


def extend_right(kmer: Column | str, base: Column) -> Column:
    return F.concat(suffix(kmer), base)


def extend_left(kmer: Column | str, base: Column) -> Column:
    return F.concat(base, prefix(kmer))


def decompose(sequence: Column | str, k: Column | int) -> Column:
    """Upper-cased overlapping k-mers in order; empty if the sequence is shorter than k."""
    k = F.lit(k) if isinstance(k, int) else k

    def cut(s: Column) -> Column:
        return F.when(F.length(s) >= k, F.transform(F.sequence(F.lit(1), F.length(s) - k + 1), lambda i: F.substring(s, i, k))).otherwise(F.array().cast("array<string>"))

    # as a lambda's variable the sequence is worked out once, not again for each k-mer
    return F.transform(F.array(F.upper(col(sequence))), cut)[0]


def path_sequence(path: Column | str) -> Column:
    """The sequence a path of k-mers spells: the first one and the last base of each next one."""
    p = col(path)
    rest = F.transform(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda x: F.right(x, F.lit(1)))
    return F.when(F.size(p) > 0, F.concat(F.element_at(p, 1), F.array_join(rest, ""))).otherwise(F.lit(""))


def path_length(path: Column | str) -> Column:
    return F.size(col(path))
