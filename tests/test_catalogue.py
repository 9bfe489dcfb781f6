from __future__ import annotations

import datetime
import math

import duckdb
import pytest

import __spark_entry__ as entry_point
from simstrata.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def same(spark, duck, sf_dir, query, sql):
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    rel = duck.sql(sql)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_duckdb(spark, duck, sf_dir, name):
    same(spark, duck, sf_dir, catalogue.queries()[name], catalogue.oracle_sql()[name])


@pytest.mark.parametrize("name", ["ccf_roundtrip", "pack_roundtrip"])
def test_round_trips(spark, sf_dir, name):
    rows = catalogue.queries()[name](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.ok for r in rows)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
