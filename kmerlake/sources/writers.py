"""Writing calls and results: TSV, CSV, VCF, JSON, JSON lines, workbooks, reports.

Lines are made in expressions. Small results end up in one file; `directory=True` lets
Spark write large ones as a folder of parts.
"""

from __future__ import annotations

import io
import json
import sys
import zipfile
from collections.abc import Iterable, Iterator
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas
from ..functions import sequence as S

FORMATS = ("tsv", "csv", "vcf", "json", "jsonl", "xlsx")
JSON_NAMES = {"type": "variant_type", "rVAF": "rvaf"}


def fixed(name: str, digits: int) -> Column:
    """A number with that many decimals, empty for null."""
    return F.when(F.col(name).isNull(), "").otherwise(F.format_string(f"%.{digits}f", name))


def text_of(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def call_cells() -> list[Column]:
    digits = {"rVAF": 6, "expression": 2, "qual": 2, "ci_lower": 6, "ci_upper": 6}
    out = []
    for name in schemas.CALL_COLUMNS:
        if name in digits:
            out.append(fixed(name, digits[name]).alias(name))
        elif name == "pvalue":
            out.append(F.when(F.col(name).isNull(), "").otherwise(S.scientific(name)).alias(name))
        else:
            out.append(text_of(name).alias(name))
    return out


def filter_cells() -> list[Column]:
    digits = {"kmer_vaf": 6, "kmer_expression": 2}
    return [(fixed(n, digits[n]) if n in digits else text_of(n)).alias(n) for n in schemas.FILTER_COLUMNS]


def coverage_cells() -> list[Column]:
    digits = {"mean_coverage": 2, "median_coverage": 1, "stdev": 2, "cv": 4}
    names = ["target", "num_kmers", "mean_coverage", "median_coverage", "min_coverage", "max_coverage", "stdev", "cv"]
    return [(fixed(n, digits[n]) if n in digits else text_of(n)).alias(n) for n in names]


def joined(rows: DataFrame, cells: list[Column], sep: str = "\t", quote: bool = False) -> DataFrame:
    """One column `value` of lines; quoting puts cells with separators, quotes or line ends into quotes."""
    flat = rows.select(*cells)
    own = [F.col(c) for c in flat.columns]
    if quote:
        own = [F.when(c.rlike(f'[{sep}"\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in own]
    return flat.select(F.concat_ws(sep, *own).alias("value"))


#: The header of call files.
VCF_HEAD = [
    "##fileformat=VCFv4.3",
    "##source=kmerlake",
    '##INFO=<ID=KVAF,Number=1,Type=Float,Description="K-mer variant allele frequency">',
    '##INFO=<ID=KCOV,Number=1,Type=Integer,Description="Minimum k-mer coverage along path">',
    '##INFO=<ID=KEXP,Number=1,Type=Float,Description="K-mer expression estimate">',
    '##INFO=<ID=KTYPE,Number=1,Type=String,Description="Variant type from k-mer analysis">',
    '##INFO=<ID=KPV,Number=1,Type=Float,Description="K-mer variant p-value">',
    '##INFO=<ID=KCI_LO,Number=1,Type=Float,Description="Bootstrap CI lower bound on rVAF">',
    '##INFO=<ID=KCI_HI,Number=1,Type=Float,Description="Bootstrap CI upper bound on rVAF">',
    "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO",
]


def vcf_lines(calls: DataFrame) -> DataFrame:
    info = F.concat_ws(
        ";",
        F.format_string("KVAF=%.6f", "rVAF"),
        F.concat(F.lit("KCOV="), F.col("min_coverage").cast("string")),
        F.format_string("KEXP=%.2f", "expression"),
        F.concat(F.lit("KTYPE="), "type"),
        F.when(F.col("pvalue").isNotNull(), F.concat(F.lit("KPV="), S.scientific("pvalue"))),
        F.when(F.col("ci_lower").isNotNull(), F.format_string("KCI_LO=%.6f", "ci_lower")),
        F.when(F.col("ci_upper").isNotNull(), F.format_string("KCI_HI=%.6f", "ci_upper")),
    )
    dot = lambda c: F.coalesce(F.col(c), F.lit("."))
    qual = F.when(F.col("qual").isNull(), ".").otherwise(F.format_string("%.1f", "qual"))
    return calls.select(F.concat_ws("\t", dot("chrom"), F.coalesce("pos", F.lit(0)).cast("string"), F.lit("."), dot("ref_allele"), dot("alt_allele"), qual, F.lit("PASS"), info).alias("value"))


def json_lines(calls: DataFrame) -> DataFrame:
    rows = calls if "path_score" in calls.columns else calls.withColumn("path_score", F.col("min_coverage"))
    names = [x.split()[0] for x in schemas.CALLS_IN_MEMORY.split(", ")]
    shown = rows.select(*[(F.when(F.col(n) == "ITD", "Itd").otherwise(F.col(n)) if n == "type" else F.col(n)).alias(JSON_NAMES.get(n, n)) for n in names])
    return shown.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def lines(rows: DataFrame) -> Iterator[str]:
    return (r["value"] for r in rows.toLocalIterator())


def put(parts: Iterable[str], output: str | io.TextIOBase | None, end: str = "\n") -> None:
    """Lines to a path, an open text file, or standard output."""
    if isinstance(output, str):
        with open(output, "w", encoding="utf-8", newline="") as file:
            file.writelines(x + end for x in parts)
    else:
        (output or sys.stdout).writelines(x + end for x in parts)


def write_calls(calls: DataFrame, form: str = "tsv", output: str | io.TextIOBase | None = None, header: bool = True, directory: bool = False) -> None:
    """Calls in one of FORMATS. A workbook needs a path."""
    if form not in FORMATS:
        raise ValueError(f"formats are {', '.join(FORMATS)}")
    if form == "xlsx":
        if not isinstance(output, str):
            raise ValueError("a workbook cannot be written to a stream")
        names = schemas.CALL_COLUMNS
        numeric = {"rVAF", "expression", "min_coverage", "start_kmer_count", "pos", "pvalue", "qual", "ci_lower", "ci_upper"}
        workbook(output, names, (tuple(r[n] for n in names) for r in calls.toLocalIterator()), {i for i, n in enumerate(names) if n in numeric})
        return
    if form in ("json", "jsonl"):
        rows, head = json_lines(calls), []
    elif form == "vcf":
        rows, head = vcf_lines(calls), VCF_HEAD
    else:
        sep = "\t" if form == "tsv" else ","
        rows, head = joined(calls, call_cells(), sep, form == "csv"), [sep.join(schemas.CALL_COLUMNS)] * header
    if directory:
        rows.write.mode("overwrite").text(output)
    elif form == "json":
        put(["[" + ",\n".join(lines(rows)) + "]"], output)
    else:
        put((x for part in (head, lines(rows)) for x in part), output)


def write_table(rows: DataFrame, cells: list[Column], output: str | io.TextIOBase | None = None, sep: str = "\t", header: bool = True) -> None:
    flat = rows.select(*cells)
    put((x for part in ([sep.join(flat.columns)] * header, lines(joined(rows, cells, sep, sep == ","))) for x in part), output)


def write_filtered(rows: DataFrame, output=None, header: bool = True) -> None:
    write_table(rows, filter_cells(), output, "\t", header)


def write_coverage(rows: DataFrame, output=None, sep: str = "\t", header: bool = True) -> None:
    write_table(rows.orderBy("target"), coverage_cells(), output, sep, header)


def write_pon(pon: DataFrame, output: str) -> None:
    """A panel as one JSON document with its number of samples and today's date."""
    key = F.struct("chrom", "pos", "ref_allele", "alt_allele", "target").alias("key")
    entry = F.struct("sample_count", "total_samples", "frequency", "max_vaf", "mean_vaf").alias("entry")
    total = pon.select("total_samples").first()
    day = pon.sparkSession.sql("select date_format(current_date(), 'yyyy-MM-dd')").first()[0]
    body = pon.orderBy("chrom", "pos", "ref_allele", "alt_allele", "target").select(F.to_json(F.struct(key, entry)).alias("value"))
    put(['{"entries": [' + ",\n".join(lines(body)) + f'], "total_samples": {total[0] if total else 0}, "creation_date": "{day}"}}'], output)


STATS_FORMS = ("tsv", "text", "json")
#: Labels and decimals of the text form, and decimals of the table's.
STATS_LABELS = (("vaf_mean", "Mean"), ("vaf_median", "Median"), ("vaf_min", "Min"), ("vaf_max", "Max"), ("vaf_p5", "P5"), ("vaf_p25", "P25"), ("vaf_p75", "P75"), ("vaf_p95", "P95"))
STATS_DECIMALS = {"detection_rate": 4, "expression": 2, "vaf": 6}


def write_stats(summary: DataFrame, kinds: DataFrame, form: str = "tsv", output: str | io.TextIOBase | None = None) -> None:
    """A one-row summary, with the number of calls of each type (type, n), as a table, a text or a JSON document."""
    s = summary.first().asDict()
    types = {r["type"]: r["n"] for r in kinds.orderBy("type").collect()}  # as few rows as types
    s = {("detected_variants" if name == "detected" else name): value for name, value in s.items()}
    vafs, expressions = [x for x in s if x.startswith("vaf_")], [x for x in s if x.startswith("expression_")]
    if form == "json":
        whole = {x: s[x] for x in s if x not in expressions} | {"variant_types": types} | {x: s[x] for x in expressions}
        return write_json(whole, output)
    if form == "tsv":
        shown = lambda x: f"{s[x]:.{STATS_DECIMALS[x if x in STATS_DECIMALS else x.split('_')[0]]}f}" if isinstance(s[x], float) else str(s[x])
        rows = [(x, shown(x)) for x in s if x not in expressions] + [(f"type_{t.lower()}", str(n)) for t, n in types.items()] + [(x, shown(x)) for x in expressions]
        return put(["\t".join(row) for row in [("metric", "value"), *rows]], output)
    out = [f"{'Total targets:':<20}{s['total_targets']}", f"{'Detected variants:':<20}{s['detected_variants']}", f"{'Detection rate:':<20}{100 * s['detection_rate']:.1f}%", "", "VAF Summary:"]
    out += [f"  {label + ':':<9}{s[name]:.4f}" for name, label in STATS_LABELS if name in vafs]
    out.append("")
    if types:
        out += ["Variant Types:", *[f"  {t + ':':<15}{n}" for t, n in sorted(types.items(), key=lambda x: (-x[1], x[0]))], ""]
    out += ["Expression Summary:", *[f"  {x.split('_')[1].capitalize() + ':':<9}{s[x]:.2f}" for x in expressions]]
    return put(out, output)


def grouped_stats_cells(by: str) -> list[Column]:
    return [F.col(by), text_of("total").alias("total"), text_of("detected").alias("detected"), fixed("detection_rate", 4).alias("detection_rate"), *[fixed(c, 6).alias(c) for c in ("vaf_mean", "vaf_median")]]


def workbook(path: str, head: list[str], rows: Iterable[tuple], numeric: set[int]) -> None:
    """A minimal OOXML workbook: one sheet, bold header, numbers as numbers."""

    def column(i: int) -> str:
        out = ""
        i += 1
        while i:
            i, r = divmod(i - 1, 26)
            out = chr(65 + r) + out
        return out

    def cell(r: int, i: int, value, style: str = "") -> str:
        if value is None:
            return ""
        if i in numeric and not style and isinstance(value, (int, float)):
            return f'<c r="{column(i)}{r}"><v>{value!r}</v></c>'
        return f'<c r="{column(i)}{r}" t="inlineStr"{style}><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'

    space = "http://schemas.openxmlformats.org/"
    declaration = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{declaration}<Types xmlns="{space}package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>')
        z.writestr("_rels/.rels", f'{declaration}<Relationships xmlns="{space}package/2006/relationships"><Relationship Id="rId1" Type="{space}officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{declaration}<workbook xmlns="{space}spreadsheetml/2006/main" xmlns:r="{space}officeDocument/2006/relationships"><sheets><sheet name="Variants" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{declaration}<Relationships xmlns="{space}package/2006/relationships"><Relationship Id="rId1" Type="{space}officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{space}officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'{declaration}<styleSheet xmlns="{space}spreadsheetml/2006/main"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>')
        with z.open("xl/worksheets/sheet1.xml", "w") as file:
            file.write(f'{declaration}<worksheet xmlns="{space}spreadsheetml/2006/main"><sheetData>'.encode())
            file.write(("<row r=\"1\">" + "".join(cell(1, i, h, ' s="1"') for i, h in enumerate(head)) + "</row>").encode())
            for r, row in enumerate(rows, 2):
                file.write((f'<row r="{r}">' + "".join(cell(r, i, v) for i, v in enumerate(row)) + "</row>").encode())
            file.write(b"</sheetData></worksheet>")


def write_json(document: dict | list, output: str | io.TextIOBase | None = None) -> None:
    put([json.dumps(document, indent=2, default=str)], output)
