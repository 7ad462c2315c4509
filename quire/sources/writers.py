"""Sinks: manifests, scores, audits, leaderboards, and the cache that makes runs resumable."""

from __future__ import annotations

import json
import platform

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.files import FileSink, place_of
from quire.sources.store import stored

CSV = {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _mode(force: bool) -> str:
    return "overwrite" if force else "errorifexists"


def json_lines(df: DataFrame, path: str, order: str | None = None, force: bool = False) -> None:
    """JSON lines with nulls kept. With an order, files follow it: range partitions, sorted within."""
    out = df.repartitionByRange(F.col(order)).sortWithinPartitions(order) if order else df
    out.write.mode(_mode(force)).option("ignoreNullFields", "false").json(path)


def per_model(df: DataFrame, path: str, force: bool = False) -> None:
    """A folder a model."""
    df.write.mode(_mode(force)).partitionBy("model_id").option("ignoreNullFields", "false").json(path)


def csv(df: DataFrame, path: str, force: bool = False) -> None:
    """CSV with a header, quotes doubled and spaces kept (RFC 4180); nested columns become JSON text."""
    nested = {f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "struct", "map")}
    df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns]).write.mode(_mode(force)).csv(path, header=True, **CSV)


def raw_responses(responses: DataFrame, path: str) -> None:
    """K7: what services answered, word for word, appended to a folder a model that is kept apart from the predictions: run_id, model_id, sample_id, response."""
    responses.select("run_id", "model_id", "sample_id", F.col("response").cast("string").alias("response")).write.mode("append").partitionBy("model_id").parquet(path)


def images(files: DataFrame, path: str, force: bool = False) -> None:
    """K2: a file a row of sample_id, content (PNG), through the store that the path names. A folder that is there already is an error, or goes first with force; a job that fails leaves no file."""
    spark = files.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = target.toString()
    place_of(uri)  # a store that tasks can't write to is an error before anything is deleted
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(target):
        if not force:
            raise FileExistsError(f"refusing to overwrite {path}")
        store.delete(target, True)
    spark.dataSource.register(FileSink)
    files.select(F.concat("sample_id", F.lit(".png")).alias("name"), "content").write.format(FileSink.name()).option("path", uri).mode("append").save()


def package_freeze(spark: SparkSession) -> DataFrame:
    """K9: name, version of the driver's installed packages."""
    from importlib.metadata import distributions

    found = sorted({(d.metadata["Name"], d.version) for d in distributions() if d.metadata["Name"]})
    return spark.createDataFrame(found, "name string, version string")


#: Bits of a filter a key, and the most bits of one: beyond, it lets more through, and only the exact join that follows works more.
BITS_A_KEY, MOST_BITS = 10, 1 << 27


def _filter_of(done: DataFrame, keys: list[str]) -> Column:
    """A condition that holds for every row whose keys are in `done`, and for about one in a hundred of the others: a Bloom filter of seven bits a key, made by tasks and merged bit by bit. Its size is bounded."""
    spark = done.sparkSession
    n = max(1, done.count())
    bits = min(MOST_BITS, 64 * -(-BITS_A_KEY * n // 64))
    places = lambda: F.array(*[F.pmod(F.xxhash64(F.lit(i), *keys), F.lit(bits)) for i in range(7)])
    words = done.select(F.explode(places()).alias("p")).groupBy(F.floor(F.col("p") / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("p") % 64).cast("int"))).alias("set"))
    rows = words.toArrow()
    held = np.zeros(bits // 64, np.int64)
    held[np.asarray(rows.column("word"))] = np.asarray(rows.column("set"))
    sent = spark.sparkContext.broadcast(held)

    @F.pandas_udf("boolean")
    def all_set(places: pd.Series) -> pd.Series:
        at = np.stack(places.to_numpy()) if len(places) else np.zeros((0, 7), np.int64)
        return pd.Series(((sent.value[at >> 6] >> (at & 63)) & 1 == 1).all(1))

    return all_set(places())


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The work not done yet. Failed rows count as done only with status success.

    Most of the work is told to be pending by a filter of what is done, where it lies; only what the filter lets through, which is what is done and a little more,
    is shuffled for the exact comparison. Keys without nulls.
    """
    finished = stored(done.where("status = 'success'").select(*keys).distinct(), "done")
    seen = fresh_name(work.columns)
    told = work.withColumn(seen, _filter_of(finished, keys))
    open_ = told.where(~F.col(seen)).drop(seen)
    return open_.unionByName(told.where(seen).drop(seen).join(finished, keys, "left_anti").select(*work.columns))


def fresh_name(columns: list[str]) -> str:
    name = "quire_seen"
    while name in {c.lower() for c in columns}:
        name += "_"
    return name


def resume(work: DataFrame, spark: SparkSession, path: str, keys: list[str], run) -> DataFrame:
    """Run what is pending and append it; run maps a DataFrame of work to predictions."""
    try:
        done = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        run(work).write.parquet(path)
    else:
        run(pending(work, done, keys)).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def run_metadata(spark: SparkSession, path: str, force: bool = False, **facts: object) -> None:
    """One JSON record of a run and the versions that it used."""
    packages = [f"{r['name']}=={r['version']}" for r in package_freeze(spark).orderBy("name").collect()]
    row = {"spark": spark.version, "python": platform.python_version(), "packages": packages, **facts}
    spark.createDataFrame([(json.dumps(row, sort_keys=True),)], "value string").coalesce(1).write.mode(_mode(force)).text(path)
