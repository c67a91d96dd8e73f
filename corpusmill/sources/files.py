"""JSON sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """One record a line. Tolerant: malformed lines go; strict: they raise. Blank lines go."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").option("recursiveFileLookup", "true").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", "true").csv(path)


def read_training_log(spark: SparkSession, folder: str) -> DataFrame:
    """epoch, step, loss of the log_history in the trainer_state.json of the lexicographically last checkpoint-* folder; entries that lack one of the three go.

    Without such a folder, or a state in the last one, no rows.
    """
    schema = "epoch double, step long, loss double"
    jvm, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    base = jvm.Path(folder)
    fs = base.getFileSystem(conf)
    found = sorted(s.getPath().getName() for s in fs.listStatus(base) if s.isDirectory() and s.getPath().getName().startswith("checkpoint-")) if fs.exists(base) else []
    if not found or not fs.exists(jvm.Path(f"{folder}/{found[-1]}/trainer_state.json")):
        return spark.createDataFrame([], schema)
    log = read_json(spark, f"{folder}/{found[-1]}/trainer_state.json", f"log_history array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")
    return log.select(F.explode("log_history").alias("r")).select("r.*").na.drop()


def read_setting(spark: SparkSession, path: str, name: str, default: float) -> DataFrame:
    """One row, `name`: the number of that name in a small JSON file, or default where the file, the name or a number is missing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.range(1).select(F.lit(float(default)).alias(name))
    v = spark.read.text(path, wholetext=True).select(F.try_variant_get(F.try_parse_json("value"), f"$.{name}", "double").alias("v"))
    return v.agg(F.coalesce(F.max("v"), F.lit(float(default))).alias(name))
