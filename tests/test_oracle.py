"""Queries against their SQL in DuckDB, on the smallest tables."""

import glob
import os

import pytest

from quire.plans import queries as plans

SF = "/root/testdata/sf0.001"
NAMES = sorted(plans.ORACLE_SQL)


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, name):
    import duckdb

    import __spark_entry__ as entry

    db = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    result = db.sql(entry.oracle_sql()[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    assert got == sorted(str([plain(r[i]) for i in at]) for r in result.fetchall())


def rows_of(spark, name, folder):
    """(rows of the query, rows of its SQL), sorted."""
    import duckdb

    import __spark_entry__ as entry

    db = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}/*.parquet'" if os.path.isdir(p) else f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = entry.queries()[name](spark, str(folder))
    columns = sorted(df.columns)
    result = db.sql(entry.oracle_sql()[name])
    at = [result.columns.index(c) for c in columns]
    return sorted(str([plain(r[c]) for c in columns]) for r in df.collect()), sorted(str([plain(r[i]) for i in at]) for r in result.fetchall())


def test_near_embeddings_judges_the_signs_of_all_components(spark, tmp_path):
    """Ten of 64 signs may differ, wherever they are; eleven may not."""
    base = [1.0 if k % 3 else -1.0 for k in range(64)]
    turned = lambda places: [-3 * x if k in places else x for k, x in enumerate(base)]
    rows = [(0, base), (1, turned(range(10))), (2, turned(range(54, 64))), (3, turned(range(20, 31))), (4, base), (5, turned({63}))]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got, want = rows_of(spark, "near_embeddings", tmp_path)
    assert got == want
    import __spark_entry__ as entry

    pairs = {(r.id_a, r.id_b): r.distance for r in entry.queries()["near_embeddings"](spark, str(tmp_path)).collect()}
    assert pairs == {(0, 1): 10, (0, 2): 10, (0, 4): 0, (0, 5): 1, (2, 5): 9}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_weights_of_a_replicate_add_up_to_the_clusters(spark):
    import __spark_entry__ as entry

    weights = entry.queries()["bootstrap_weights"](spark, SF).collect()
    clusters, totals = {r.cluster_id for r in weights}, {}
    for r in weights:
        totals[r.replicate] = totals.get(r.replicate, 0) + r.weight
    assert totals == {r: len(clusters) for r in range(2000)}
