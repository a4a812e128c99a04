"""The registered SQL of this subpackage on DuckDB, on tables with odd rows too."""

import duckdb
import pytest

from plyframe.llm import queries

TABLES = "/root/testdata/sf0.001"
ODD = [(-1, None, "s"), (-2, "", None), (-3, " \t\n", "zz"), (-4, "One two\nOne two", "a"), (-5, "One two\nOne two", "a"), (-6, "  a  shared line of some length \nx", None), (-7, "A Shared line of SOME length\n\n", "a"), (-8, "a shared line of some length", "b")]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_rows_equal_the_sql(spark, tmp_path, name):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame(ODD, "doc_id long, text string, source string").selectExpr("doc_id", "text", "'en' as lang", "source", "length(text)::long as n_chars")
    docs.unionByName(odd).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    df = queries.QUERIES[name](spark, str(tmp_path))
    names = sorted(df.columns)
    told = connection.sql(queries.ORACLE[name])
    plain = lambda v: round(v, 6) if isinstance(v, float) else int(v) if type(v).__name__ == "Decimal" else v
    rows = lambda columns, data: sorted(str([plain(r[columns.index(c)]) for c in names]) for r in data)
    assert rows(df.columns, map(tuple, df.collect())) == rows(told.columns, told.fetchall())
