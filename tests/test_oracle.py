"""Every query with SQL gives DuckDB's rows on the smallest tables, and all queries keep their schema."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from fieldloom.plans import registry

NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool | int):
        return v
    if isinstance(v, float):
        return v + 0.0
    return str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    assert len(set(columns)) == len(columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    r = duck.execute(sql)
    theirs = [d[0] for d in r.description]
    assert sorted(theirs) == columns
    want = sorted((tuple(plain(x[theirs.index(c)]) for c in columns) for x in r.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["group_metrics", "paired_bootstrap", "physical_fields", "thermal_windows", "climatology"])
def test_partitions_do_not_matter(spark, sf, name):
    seen = []
    for n in ("1", "7", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = registry.queries()[name](spark, sf)
        seen.append(sorted((tuple(r) for r in df.collect()), key=repr))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1] == seen[2]
