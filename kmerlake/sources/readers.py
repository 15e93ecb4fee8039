"""Reading k-mer tables, FASTA, calls, expected and true variants, panels and configurations."""

from __future__ import annotations

import tomllib
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas


def sample_of(path: str) -> str:
    """A file's name without its last suffix, `unknown` for nothing."""
    return PurePosixPath(path).stem or "unknown"


def sample_column() -> Column:
    name = F.regexp_extract(F.col("_metadata.file_name"), "^(.+?)(\\.[^.]*)?$", 1)
    return F.when(name == "", F.lit("unknown")).otherwise(name)


def kmer_table(spark: SparkSession, path: str, sample: str | None = None) -> DataFrame:
    """sample, k, kmer, count from a dump (`kmer`, tab or space, `count`; a header is skipped) or a Parquet table."""
    if path.rstrip("/").endswith(".parquet"):
        rows = spark.read.parquet(path)
        rows = rows if "sample" in rows.columns else rows.withColumn("sample", F.lit(sample or sample_of(path)))
    else:
        text = spark.read.text(path).select(F.lit(sample) if sample else sample_column(), "value").toDF("sample", "value")
        rows = text.select("sample", F.regexp_extract("value", "^\\s*([ACGTacgt]+)\\s+(\\d+)\\s*$", 1).alias("kmer"), F.regexp_extract("value", "\\s(\\d+)\\s*$", 1).try_cast("long").alias("count")).filter("kmer <> '' and count is not null")
    return rows.select("sample", F.length("kmer").alias("k"), F.upper("kmer").alias("kmer"), F.col("count").cast("long").alias("count"))


def fasta(spark: SparkSession, *paths: str) -> DataFrame:
    """target, sequence, source of all records of files or, recursively, of folders' .fa, .fasta and .fna files.

    A record is whatever stands between two lines that begin with `>`, so one file may be
    read by many tasks. An error if there is no record.
    """
    out = None
    for path in paths:
        reader = spark.read.option("lineSep", "\n>").option("recursiveFileLookup", "true")
        named = path.lower().endswith((".fa", ".fasta", ".fna"))
        reader = reader if named else reader.option("pathGlobFilter", "*.{fa,fasta,fna}")
        rows = reader.text(path).select(F.regexp_replace("value", "^>", "").alias("v"), F.col("_metadata.file_path").alias("source"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no targets loaded")
    lines = out.select(F.split(F.regexp_replace("v", "\r", ""), "\n").alias("l"), "source")
    found = lines.select(F.trim(F.col("l")[0]).alias("target"), F.upper(F.regexp_replace(F.array_join(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0))), ""), "\\s", "")).alias("sequence"), "source").filter("target <> '' or sequence <> ''")
    if found.isEmpty():
        raise ValueError("no targets loaded")
    return found


def _rows(spark: SparkSession, path: str, names: list[str], sep: str = "\t") -> DataFrame:
    """A text table with a header line, by position, as strings; missing cells are null."""
    return spark.read.csv(path, sep=sep, header=True, schema=", ".join(f"`{n}` string" for n in names), enforceSchema=True, mode="PERMISSIVE", quote="" if sep == "\t" else '"')


def calls(spark: SparkSession, path: str, sep: str = "\t", line: bool = False) -> DataFrame:
    """Calls by position: bad numbers become 0 or, where a value may be missing, null; an unknown type is an error.

    line adds `_line`, by which the rows of one file are in the order of its lines.
    """
    fields = [x.split() for x in schemas.CALLS.split(", ")]
    raw = _rows(spark, path, [n for n, _ in fields], sep)
    optional = {"chrom", "pos", "ref_allele", "alt_allele", "pvalue", "qual", "ci_lower", "ci_upper"}
    kinds = F.create_map(*[F.lit(x) for t in schemas.VARIANT_TYPES for x in (t.lower(), t)])
    out = []
    for name, kind in fields:
        c = F.col(name)
        if name == "type":
            known = F.element_at(kinds, F.lower(c))
            value = F.when(known.isNotNull(), known).otherwise(F.raise_error(F.concat(F.lit("unknown variant type: "), F.coalesce(c, F.lit("")))))
        elif kind == "string":
            value = F.when(c != "", c) if name in optional else F.coalesce(c, F.lit(""))
        else:
            value = c.try_cast(kind) if name in optional else F.coalesce(c.try_cast(kind), F.lit(0).cast(kind))
        out.append(value.alias(name))
    if line:
        # a block is read by one task, in order
        out.append(F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("_line"))
    return raw.select(*out).withColumn("path_score", F.col("min_coverage"))


def json_calls(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Calls written as JSON (an array: multi_line) or JSON lines."""
    from .writers import JSON_NAMES

    names = {json: own for own, json in JSON_NAMES.items()}
    schema = ", ".join(f"{JSON_NAMES.get(n, n)} {t}" for n, t in (x.split() for x in schemas.CALLS_IN_MEMORY.split(", ")))
    rows = spark.read.schema(schema).json(path, multiLine=multi_line).withColumnsRenamed(names)
    return rows.withColumn("type", F.when(F.col("type") == "Itd", "ITD").otherwise(F.col("type")))


def _strict(c: Column, kind: str, what: str) -> Column:
    return F.when(c.try_cast(kind).isNotNull(), c.try_cast(kind)).otherwise(F.raise_error(F.concat(F.lit(f"bad {what}: "), F.coalesce(c, F.lit("")))).cast(kind))


def expected(spark: SparkSession, path: str) -> DataFrame:
    """Expected variants; a position that is no number is an error."""
    raw = _rows(spark, path, ["chrom", "pos", "ref_allele", "alt_allele", "variant_type"])
    return raw.select("chrom", _strict(F.col("pos"), "long", "position").alias("pos"), *[F.coalesce(x, F.lit("")).alias(x) for x in ("ref_allele", "alt_allele", "variant_type")])


def truth(spark: SparkSession, path: str) -> DataFrame:
    """True variants; a position or share that is no number is an error, an empty category null."""
    raw = _rows(spark, path, ["chrom", "pos", "ref_allele", "alt_allele", "variant_type", "true_vaf", "category"])
    return raw.select("chrom", _strict(F.col("pos"), "long", "position").alias("pos"), "ref_allele", "alt_allele", "variant_type", _strict(F.col("true_vaf"), "double", "share").alias("true_vaf"), F.when(F.col("category") != "", F.col("category")).alias("category"))


def floats(text: str) -> list[float]:
    return [float(x) for x in text.split(",")]


PON_JSON = "entries array<struct<key:struct<chrom:string,pos:bigint,ref_allele:string,alt_allele:string,target:string>,entry:struct<sample_count:bigint,frequency:double,max_vaf:double,mean_vaf:double>>>, total_samples long, creation_date string"


def pon(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(PON_JSON).json(path, multiLine=True)
    return rows.select(F.explode("entries").alias("e"), "total_samples").select("e.key.*", "e.entry.*", "total_samples")


def config(path_or_text: str) -> dict:
    """A TOML file's, or text's, tables."""
    if "\n" in path_or_text or "=" in path_or_text:
        return tomllib.loads(path_or_text)
    with open(path_or_text, "rb") as file:
        return tomllib.load(file)


def foreign_calls(raw: DataFrame) -> DataFrame:
    """Calls from the table of the older tool.

    raw: Database, Query, Type, Variant_name, rVAF, Expression, Min_coverage,
    Start_offset, Sequence, Reference_expression, Reference_sequence, Info. Names are
    `p:R/A:q`, `p:insN:q`, `p:delN:q` or `p:ITDN:q`; of several joined by | the first.
    """
    name = F.split(F.coalesce("Variant_name", F.lit("")), "\\|")[0]
    pick = lambda form, i: F.regexp_extract(name, form, i)
    slash, ins, dele, itd = "^(\\d+):([^/:]*)/([^/:]*):(\\d+)$", "^(\\d+):ins([A-Za-z]+):(\\d+)$", "^(\\d+):del([A-Za-z]+):(\\d+)$", "^(\\d+):ITD([A-Za-z]+):(\\d+)$"
    old = F.when(name.rlike(slash), pick(slash, 2)).when(name.rlike(dele), pick(dele, 2)).when(name.rlike(f"{ins}|{itd}"), "")
    new = F.when(name.rlike(slash), pick(slash, 3)).when(name.rlike(ins), pick(ins, 2)).when(name.rlike(itd), pick(itd, 2)).when(name.rlike(dele), "")
    kinds = F.create_map(*[F.lit(x) for t in schemas.VARIANT_TYPES for x in (t.lower(), t)])
    kind = F.coalesce(F.element_at(kinds, F.lower("Type")), F.when(name.rlike(ins), "Insertion").when(name.rlike(dele), "Deletion").when(name.rlike(itd), "ITD"), F.lit("Reference"))
    number = lambda c, t: F.coalesce(F.nanvl(F.col(c).try_cast("double"), F.lit(0.0)), F.lit(0.0)).cast(t)
    return raw.select(
        F.coalesce("Database", F.lit("")).alias("sample"),
        F.coalesce("Query", F.lit("")).alias("target"),
        kind.alias("type"),
        F.when(kind == "Reference", "").otherwise(name).alias("variant_name"),
        number("rVAF", "double").alias("rVAF"),
        number("Expression", "double").alias("expression"),
        number("Min_coverage", "long").alias("min_coverage"),
        F.lit(0).cast("long").alias("start_kmer_count"),
        F.coalesce("Reference_sequence", F.lit("")).alias("ref_sequence"),
        F.coalesce("Sequence", F.lit("")).alias("alt_sequence"),
        F.coalesce("Info", F.lit("")).alias("info"),
        *[F.lit(None).cast(t).alias(n) for n, t in (("chrom", "string"), ("pos", "long"))],
        old.alias("ref_allele"),
        new.alias("alt_allele"),
        *[F.lit(None).cast("double").alias(n) for n in ("pvalue", "qual", "ci_lower", "ci_upper")],
    )
