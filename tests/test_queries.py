"""Every registered query with SQL equals DuckDB on the smallest test tables."""

import math
import os

import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return f"{float(x):.9g}"
    return str(x)


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    found = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted_rows(df.columns, map(tuple, df.collect())) == sorted_rows(names, found.fetchall())


def test_fisher_combined_equals_sql_where_p_values_vanish(spark, tmp_path):
    import duckdb
    import pandas as pd

    rows = [(50 * i + t, 10, 1, float(i), 0.01, 0.05 + 0.01 * (i % 3 == 0)) for t, n in enumerate((3, 780, 850, 858, 866, 874, 1300)) for i in range(n)]
    pd.DataFrame(rows, columns=["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"]).astype({"l_linenumber": "int32"}).to_parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    want = {r[1]: r[3] for r in con.execute(entry.oracle_sql()["fisher_combined"]).fetchall()}
    got = {r["target"]: r["minus_log10"] for r in entry.queries()["fisher_combined"](spark, str(tmp_path)).collect()}
    assert got == want and math.isinf(got["T6"]) and sum(308 < x < 324 for x in got.values()) > 1


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["detect_calls", "detect_outcomes"])
def test_detection_is_registered_with_the_defaults(spark, monkeypatch, name):
    from kmerlake.operators import detect, local

    used = []
    whole = detect.attempts
    monkeypatch.setattr(detect, "attempts", lambda targets, kmers, k, o=detect.DetectOptions(), **more: used.append(o) or whole(targets, kmers, k, o, **more))
    entry.queries()[name](spark, FOLDER)
    assert [(o.walk, o.prune) for o in used] == [(local.WalkOptions(max_node=10000), local.PruneOptions())]
