"""Queries against DuckDB on the smallest tables, and the driver contract."""

import math
import os

import pytest

import __spark_entry__ as entry
from corpusmill.plans import catalogue

DATA = "/root/testdata/sf0.001"
SLOW = {"tag_format_score"}


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return v if isinstance(v, (int, str, bool, type(None))) else str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{name}')")
    return c


@pytest.mark.parametrize("name", sorted(set(catalogue.SQL) - SLOW))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(map(value, r)) for r in df.select(columns).collect()), key=repr)
    result = duck.execute(catalogue.SQL[name])
    names = [x[0] for x in result.description]
    want = sorted((tuple(value(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert sorted(names) == columns and got == want


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stage_sanitizer_reads_whole_texts(spark, tmp_path):
    import duckdb

    base = "".join(f"Line {i:03d} stands here. " for i in range(60))
    texts = [
        base, base[:1010] + "X" + base[1011:], base * 20, "short", "\U0001f600ab" * 400, "ab", "", base + "\nThe user said so; all of it\n\n  \t" + base * 2, "<b>" * 300, ("word; " * 90 + "\n") * 9,
        base * 2 + "<fused_image> again " + base + "</fused_image>" + base, "\"quoted: " * 60, "x" * 5000,
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["digest"] for r in catalogue.QUERIES["stage_sanitizer"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == dict(c.execute(catalogue.SQL["stage_sanitizer"]).fetchall()) and len(set(got.values())) == len(texts) - 1  # nothing is left of "" and of the tags


def test_token_image_blocks_of_many_suppliers(spark, tmp_path):
    import duckdb

    # Start, two sizes, a code, end; the last suppliers' numbers lie beyond the vocabulary's codes.
    rows = [(o, n, part, supplier) for o, supplier in enumerate((0, 16383, 16384, 59999)) for n, part in enumerate((5, 2, 2, 3, 6))]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long")
    lines.selectExpr("*", "1.0d as l_quantity", "1.0d as l_extendedprice", "timestamp_ntz'2024-01-01 00:00:00' as l_shipdate").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = sorted(tuple(r) for r in catalogue.QUERIES["token_image_blocks"](spark, str(tmp_path)).collect())
    c = duckdb.connect()
    c.execute(f"create view lineitem as select * from read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    assert got == sorted(c.execute(catalogue.SQL["token_image_blocks"]).fetchall()) and [r[0] for r in got] == [0, 1, 2, 3]
