"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or set on the context; only a local master may go without and gets one beside its warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/corpusmill-core").rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df as a table of its own in the shared folder, so that several readers don't work it out again and lost executors cost nothing."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out to more tasks if it is read from fewer splits than there are cores: one Parquet file with one row group is one task, however dear its rows are.

    A large table stays as it is, and so does whatever comes out of a join or shuffle, whose tasks would be known only after it ran.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
