"""Sources: registries, manifests, predictions and image bytes as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.manifest import relative_path
from quire.sources import schemas


#: RFC 4180: quotes are doubled, and quoted fields may have line breaks (CRLF within them comes as LF where rows end with CRLF). A byte order mark is allowed.
CSV = {"header": True, "escape": '"', "multiLine": True}
BROKEN = "quire_broken"


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """The registry of systems: CSV with a header. A row that doesn't fit fails the job; `csv_rows` sets such rows aside."""
    return spark.read.schema(schemas.CANDIDATES).csv(path, mode="FAILFAST", **CSV)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped and a broken one fails the job. `json_rows` sets broken ones aside."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def csv_rows(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows of the schema, rejected): rejected are rows with another number of fields, or with a field that isn't of its type, as file, row (the text, or the fields as JSON) and reasons."""
    fields = T.StructType.fromDDL(schema).fields
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in fields] + [T.StructField(BROKEN, T.StringType())])
    read = spark.read.schema(texts).csv(path, mode="PERMISSIVE", columnNameOfCorruptRecord=BROKEN, **CSV).withColumn("file", F.input_file_name())
    cast = {f.name: F.col(f"`{f.name}`").try_cast(f.dataType) for f in fields}
    wrong = [F.when(F.col(f"`{f.name}`").isNotNull() & cast[f.name].isNull(), F.lit(f"{f.name}: not {f.dataType.simpleString()}")) for f in fields]
    reasons = F.when(F.col(BROKEN).isNotNull(), F.array(F.lit("another number of fields"))).otherwise(F.array_compact(F.array(*wrong)))
    judged = read.withColumn("reasons", reasons)
    row = F.coalesce(F.col(BROKEN), F.to_json(F.struct(*[f"`{f.name}`" for f in fields])))
    good = judged.where(F.size("reasons") == 0).select(*[c.alias(n) for n, c in cast.items()])
    return good, judged.where(F.size("reasons") > 0).select("file", row.alias("row"), "reasons")


def json_rows(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows of the schema, rejected): rejected are lines that are no JSON objects, or have a field that isn't of its type, as file, row and reasons. Blank lines are neither."""
    fields = T.StructType.fromDDL(schema).fields
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file")).where("trim(value) <> ''")
    typed = T.StructType([*fields, T.StructField(BROKEN, T.StringType())])
    read = lines.withColumn("r", F.from_json("value", typed, {"columnNameOfCorruptRecord": BROKEN}))
    raw = F.try_parse_json("value")
    object_ = F.startswith(F.schema_of_variant(raw), F.lit("OBJECT"))
    wrong = [F.when(F.try_variant_get(raw, f"$['{f.name}']", "variant").isNotNull() & F.from_json("value", T.StructType([f]), {"mode": "PERMISSIVE"})[f.name].isNull() & ~F.is_variant_null(F.try_variant_get(raw, f"$['{f.name}']", "variant")), F.lit(f"{f.name}: not {f.dataType.simpleString()}")) for f in fields]
    named = F.array_compact(F.array(*wrong))
    reasons = F.when(raw.isNull(), F.array(F.lit("no JSON"))).when(~object_, F.array(F.lit("no object"))).when(F.col(f"r.{BROKEN}").isNotNull(), F.when(F.size(named) > 0, named).otherwise(F.array(F.lit("a field inside isn't of its type")))).otherwise(F.array().cast("array<string>"))
    judged = read.withColumn("reasons", reasons)
    return judged.where(F.size("reasons") == 0).select(*[F.col(f"r.`{f.name}`").alias(f.name) for f in fields]), judged.where(F.size("reasons") > 0).select("file", F.col("value").alias("row"), "reasons")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, schemas.SAMPLES)


def robustness(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, schemas.ROBUSTNESS)


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions of all runs; in folders model_id=... the folder names the model."""
    return json_lines(spark, path, schemas.PREDICTIONS)


def images(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """path, content, length of image files (line images are PNG; pages, "*.jpg"); bytes are only read where content is used."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content", "length")


def with_images(samples: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """samples with `content`, null where the file is missing. image_path is relative to the root, and so are the files' paths made: equal ones meet, a file at most. Only files that are asked for are shuffled with their bytes."""
    spark = files.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    top = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()
    keyed = files.select(relative_path(F.col("path"), top).alias("image_path"), "content")
    wanted = keyed.join(samples.select("image_path").distinct(), "image_path", "left_semi")
    return samples.join(wanted, "image_path", "left")


def _yaml(text: str):
    """YAML, of which JSON is a part: where no YAML library is installed, JSON is all that can be read, and anything else is an error."""
    try:
        import yaml
    except ImportError:
        import json

        return json.loads(text)
    return yaml.safe_load(text)


def registry(spark: SparkSession, text: str) -> DataFrame:
    """A list of models."""
    names = [f.split()[0] for f in schemas.REGISTRY.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in _yaml(text)], schemas.REGISTRY)


def prompts(spark: SparkSession, text: str) -> DataFrame:
    """prompt_id, text, prompt_hash of a mapping of prompts."""
    import hashlib

    return spark.createDataFrame([(k, v, hashlib.sha256(v.encode()).hexdigest()) for k, v in _yaml(text).items()], "prompt_id string, text string, prompt_hash string")


def benchmark_config(text: str) -> dict:
    """Weights of metrics and strata, replicates, seed. Weights must sum to one."""
    found = {"metric_weights": schemas.METRIC_WEIGHTS, "stratum_weights": schemas.STRATUM_WEIGHTS, "replicates": 2000, **_yaml(text)}
    for k in ("metric_weights", "stratum_weights"):
        if abs(sum(found[k].values()) - 1) > 1e-9:
            raise ValueError(f"{k} sum to {sum(found[k].values())}")
    return found
