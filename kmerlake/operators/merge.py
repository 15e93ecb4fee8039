"""Merging call tables of several runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F


def merged(tables: list[DataFrame], deduplicate: bool = False, key: list[str] = ("sample", "target", "variant_name"), order: list[str] = ()) -> DataFrame:
    """All rows of tables with the same columns in the same order; an error if they differ.

    deduplicate keeps the first row of each key: that of the first table, then by order
    (the remaining columns where none is given). Of tables that were read with `_line`
    that is the first line, and the column goes.
    """
    if not tables:
        raise ValueError("nothing to merge")
    names = tables[0].columns
    for i, t in enumerate(tables):
        if t.columns != names:
            raise ValueError(f"table {i} has columns {t.columns}, not {names}")
    rows = reduce(DataFrame.unionByName, [t.withColumn("_file", F.lit(i)) for i, t in enumerate(tables)])
    if deduplicate:
        over = Window.partitionBy(*key).orderBy("_file", *(order or (["_line"] if "_line" in names else [c for c in names if c not in key])))
        rows = rows.withColumn("_n", F.row_number().over(over)).filter("_n = 1")
    return rows.select(*[c for c in names if c != "_line"])
