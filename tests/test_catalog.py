"""Every registered query that has SQL, against DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__
from quillon.plans import catalog


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(repr, df.where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", catalog.SQL)
def test_same_as_sql(spark, data, duck, name):
    got, want = catalog.QUERIES[name](spark, data).toPandas(), duck.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.SQL])
def test_runs(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() > 0


def test_rerank_takes_all_documents(spark, data):
    """The pool is the top of the ranking of all documents, not a range of ids."""
    ranked = {r["id"]: r["fused_rank"] for r in catalog.QUERIES["rrf_fuse"](spark, data).collect()}
    docs = {r["doc_id"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id").collect()}
    got = {r["id"] for r in catalog.QUERIES["rerank_fused"](spark, data).collect()}
    assert got == {i for i in docs if ranked.get(i, 51) <= 50} and max(got) >= 50


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["doc_id", "lang", "source", "position"] and out.count() > 0


def test_registry():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
