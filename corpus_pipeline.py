"""The corpus pipeline: toxic documents and near copies go, repeated passages are cut, sources are mixed, and the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
Between stages the documents are written as Parquet and read again.

A null text is empty. Rows without an id stay in every stage (no label and no smaller id can name them), and rows of one id are judged one by one by
the classifier and together as near copies. Of near copies the least id stays; of equal rows, ids and passages no more is cut than the stages say. A document that the mix
takes no words of, an empty one too, has no row after it. No documents give no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quire.llm import mixing, packing, simhash, substring, toxicity
from quire.llm.common import shared_folder, table
from quire.llm.queries import vocabulary


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.without_near_copies(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.cleaned(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, vocabulary())


STAGES = [("toxicity", toxic), ("simhash near-dedup", near_copies), ("substring dedup", passages), ("source mixing", mix), ("best-fit packing", pack)]

#: SQL can't express the classifier, the tokenizer or the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            path = f"{shared_folder(spark)}/quire-stage-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
