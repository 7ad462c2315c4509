"""Intermediate tables, in the folder that the driver and all executors share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: While a table is made: its shuffle files go as soon as it is there, and rows go to Python in batches that stay small where texts are long.
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a temporary folder for a local master, whose tasks run on this machine, and an error for any other."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='quire-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def place(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/quire-{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, computed once and kept as Parquet in the shared folder. Cuts lineage; a lost executor costs nothing of it. The shuffle files that made it go at once."""
    spark = df.sparkSession
    path, before = place(spark, label), {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Takes tables that `stored` gave, and that nothing reads any more, off the disk."""
    for table in tables:
        spark = table.sparkSession
        for folder in {re.sub(r"/[^/]*$", "", f) for f in table.inputFiles()}:
            if re.search(r"/quire-[^/]*$", folder):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidied(spark: SparkSession) -> None:
    """Between the rounds of a long job: the driver lets go of plans, broadcasts and shuffle files of tables that are gone, which it else keeps until its memory is full."""
    gc.collect()
    spark._jvm.System.gc()
