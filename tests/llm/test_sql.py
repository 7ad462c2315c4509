"""Queries of the training-data operators against their SQL in DuckDB, on the smallest tables and on tables with nulls and repeated rows."""

import glob
import os

import pytest

from quire.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def same(spark, name, folder):
    import duckdb

    db = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    result = db.sql(ORACLE_SQL[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    got = sorted(str([r[c] for c in columns]) for r in df.collect())
    assert got == sorted(str([r[i] for i in at]) for r in result.fetchall())
    return len(got)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, name):
    assert same(spark, name, SF) > 0


@pytest.mark.parametrize("name", ["op11_filter_interaction_audit", "op13_collocation_mining"])
def test_same_rows_of_odd_tables(spark, tmp_path, name):
    text = "New York is NEW york. new york, is | new york\tis\x0bnew york " * 4
    rows = [(1, text, "en"), (2, text, "en"), (2, text, "en"), (3, None, "en"), (4, "", None), (5, text, None), (6, text + "€ x", ""), (None, text, "en"), (-1, "a b " * 40, "fr")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 0), (None, 1, 1), (-1, None, 1)], "doc_id bigint, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    assert same(spark, name, str(tmp_path)) > 0
