"""The pipeline on tables without rows, and on rows with nulls."""

import pytest

import corpus_pipeline

DOCS = "doc_id bigint, text string, lang string, source string, n_chars int"


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, None, "en", "a", 0), (1, "", None, None, None), (2, "one word " * 30, "en", None, None), (None, "one word " * 30, "en", "a", 270)]])
def test_odd_tables(spark, tmp_path, rows):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert (len(got) == 0) == (not rows) and all(r.length > 0 for r in got)
