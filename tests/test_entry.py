import importlib
import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from terravane.plans import catalogue, edges, fields

NAMES = sorted(catalogue.oracle_sql() | edges.oracle_sql() | fields.oracle_sql())


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    found = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == names
    want = sorted((tuple(plain(r[columns.index(c)]) for c in names) for r in found.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.queries() | edges.queries() | fields.queries()) - set(NAMES)))
def test_query_without_sql_runs(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() > 0


def test_projection_is_exact(spark, sf):
    assert entry.queries()["utm_round_trip"](spark, sf).filter("not exact").isEmpty()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_filter_reaches_the_scan(spark, sf):
    from pyspark.sql import functions as F

    from terravane.functions.calendar import in_years

    plan = spark.read.parquet(f"{sf}/lineitem.parquet").filter(in_years(F.col("l_shipdate"), last=1999)).select("l_quantity")._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(l_shipdate" in plan and "ReadSchema: struct<l_quantity:double,l_shipdate" in plan


def test_entry_without_corpus(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        bare = importlib.reload(entry)
        assert "stress_target" in bare.queries() and "pipeline" not in bare.queries()
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
