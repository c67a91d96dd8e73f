"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import types
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or set on the context. Where neither is, a local master gets a folder beside the warehouse; a cluster raises, for its executors wouldn't see one of the driver's."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        sc.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir')}/corpusmill-shared")
    return sc._jsc.sc().getCheckpointDir().get()


def kept(key: tuple, make):
    """make(), called once in a process: workers unpickle this package's functions for each task, so their own globals don't last."""
    held = sys.modules.setdefault("_corpusmill_kept", types.ModuleType("_corpusmill_kept")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def give_back() -> None:
    """Freed memory of this worker goes back to the system, as far as its allocators can tell: else it counts against the executor for as long as the worker lives."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def written(df: DataFrame, keep_path: bool = False):
    """df with its lineage cut by a compressed table in the shared folder: less disk than a checkpoint, and of known size for joins. With keep_path, (path, df), for who erases it."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    again = df.sparkSession.read.schema(df.schema).parquet(path)
    return (path, again) if keep_path else again


def erase(spark: SparkSession, path: str) -> None:
    """Deletes a table of our own in the shared folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def hash_unit(*cols) -> Column:
    """A value in [0, 1) that depends on the values of cols only."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) / F.lit(float(1 << 52))


def n_words(text) -> Column:
    """Number of runs of characters other than ASCII white space (space, tab to carriage return); null counts 0."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def let(value: Column, body) -> Column:
    """body(value), with value worked out once: a lambda's argument is a variable, also where body uses it for every element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fresh(name: str, columns) -> str:
    """name, with leading underscores until it is none of columns, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
