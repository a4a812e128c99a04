"""Every query with an oracle equals DuckDB on the small tables."""

import importlib
import os

import duckdb
import pandas as pd
import pytest

from plyframe import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(repr(tuple(None if pd.isna(x) else x.item() if hasattr(x, "item") else x for x in row)) for row in frame.itertuples(index=False, name=None)), sorted(frame.columns)


def compare(spark, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = query(spark, SF).toPandas(), con.sql(sql).df()
    number = lambda rows: [r.replace(".0,", ",").replace(".0)", ")") for r in rows]
    (a, names), (b, other) = plain(got), plain(want)
    assert names == other
    assert number(a) == number(b)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_oracle(spark, name):
    compare(spark, catalog.QUERIES[name], catalog.ORACLE[name])


def test_entry_module(spark):
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
    assert os.path.exists(entry.__file__)
