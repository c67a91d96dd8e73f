"""Models from outside over text columns: loaded once in a worker, fed in batches, with a value for what fails."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def loaded(name: str, load: Callable[[], Callable]) -> Callable:
    """load(), called once in a process for each name: the worker keeps the model from task to task, which this module's own globals wouldn't."""
    held = sys.modules.setdefault("_corpusmill_models", types.ModuleType("_corpusmill_models")).__dict__
    if name not in held:
        held[name] = load()
    return held[name]


def modelled(df: DataFrame, text_col: str, into: str, name: str, load: Callable[[], Callable[[list[str]], list]], kind: str = "string", batch: int = 32, failed=None) -> DataFrame:
    """df with into, of the Spark type `kind`: what the model gives for the text.

    load() returns a function of a list of texts to a list of values, such as a scorer, an encoder or a generator. It is called for `batch` texts at a time; a batch that
    raises is tried text by text, and a text that raises gets `failed` ('' for generators, zeros for encoders). Null texts count as empty.
    """
    import pyspark.sql.pandas.types as spark_types

    field = df.sparkSession.createDataFrame([], f"x {kind}").schema["x"].dataType
    arrow = spark_types.to_arrow_type(field)

    def run(texts: pa.Array) -> pa.Array:
        model = loaded(name, load)

        def one(t: str):
            try:
                return model([t])[0]
            except Exception:  # the model's own, whatever it is: the text gets the value for failures
                return failed

        out = []
        rows = [t or "" for t in texts.to_pylist()]
        for at in range(0, len(rows), batch):
            part = rows[at : at + batch]
            try:
                got = list(model(part))
                if len(got) != len(part):
                    raise ValueError("a model must give a value for each text")
            except Exception:
                got = [one(t) for t in part]
            out += got
        return pa.array(out, arrow)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return df.withColumn(into, F.arrow_udf(run, field)(F.col(text_col)))


def by_models(df: DataFrame, text_col: str, into: str, models: dict[str, Callable[[], Callable]], kind: str = "string", batch: int = 32, failed=None) -> DataFrame:
    """df once for each model, with its name in `model`: rows are read again for each, and never multiplied before a model has run."""
    out = None
    for name, load in models.items():
        part = modelled(df, text_col, into, name, load, kind, batch, failed).withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
