"""Sequence context, names and formats over columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .kmers import col


def max_homopolymer(s: Column | str) -> Column:
    """Length of the longest run of one base; null for an empty sequence."""
    runs = F.regexp_extract_all(F.upper(col(s)), F.lit("((.)\\2*)"), F.lit(1))
    return F.array_max(F.transform(runs, F.length))


def gc_content(s: Column | str) -> Column:
    n = F.length(col(s))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(F.upper(col(s)), "[^GC]", "")) / n)


def low_complexity(s: Column | str) -> Column:
    """Ten bases or more of which fewer than half of all 3-mers are distinct."""
    u = F.upper(col(s))
    n = F.length(u)
    kinds = F.size(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(u, i, F.lit(3)))))
    return (n >= 10) & (kinds < F.lit(0.5) * (n - 2))


def shared_prefix(a: Column | str, b: Column | str) -> Column:
    """How many leading characters agree."""
    a, b = col(a), col(b)
    differs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y)
    at = F.array_position(differs, True)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0)).otherwise(F.coalesce(F.nullif(at, F.lit(0)) - 1, F.least(F.length(a), F.length(b)))).cast("int")


def shared_suffix(a: Column | str, b: Column | str) -> Column:
    return shared_prefix(F.reverse(col(a)), F.reverse(col(b)))


def bare_chrom(c: Column | str) -> Column:
    """Without a leading `chr`, in that case only."""
    return F.regexp_replace(col(c), "^chr", "")


def safe_file_name(s: Column | str) -> Column:
    return F.regexp_replace(col(s), "[^\\p{L}\\p{N}_-]", "_")


def short_kmer(s: Column | str) -> Column:
    """Five first and five last bases of a k-mer over 15."""
    s = col(s)
    return F.when(F.length(s) > 15, F.concat(F.left(s, F.lit(5)), F.lit("..."), F.right(s, F.lit(5)))).otherwise(s)


def scientific(x: Column | str, digits: int = 6) -> Column:
    """`1.234500e-4`: an exponent without plus sign and without leading zeros."""
    text = F.format_string(f"%.{digits}e", col(x))
    return F.regexp_replace(text, "e([-]?)\\+?0*(\\d)", "e$1$2")


def phred(p: Column | str) -> Column:
    p = col(p)
    return F.when(p <= 0, F.lit(999.0)).when(p >= 1, F.lit(0.0)).otherwise(F.least(F.lit(999.0), F.lit(-10.0) * F.log10(p)))


def from_phred(q: Column | str) -> Column:
    q = col(q)
    return F.when(q <= 0, F.lit(1.0)).otherwise(F.pow(F.lit(10.0), -q / 10))
