"""Records through the staged cleaner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.cleaning import clean
from corpusmill.operators.stored import spread


def judged(df: DataFrame, *fields: str) -> DataFrame:
    """df with its text fields cleaned and __dropped_at: the pass at which the first dropped field goes, null if the record is kept. Null fields are left alone."""
    made = {f"__c{i}": clean(F.col(f"`{f}`")) for i, f in enumerate(fields)}
    wide = spread(df).withColumns(made)
    out = wide.withColumns({f: F.col(f"{c}.text") for f, c in zip(fields, made)})
    return out.withColumn("__dropped_at", F.coalesce(*[F.col(f"{c}.dropped_at") for c in made])).drop(*made)


def clean_records(df: DataFrame, *fields: str) -> DataFrame:
    """The records that every field survives, with the cleaned texts."""
    return judged(df, *fields).where("__dropped_at is null").drop("__dropped_at")


def clean_counters(df: DataFrame, *fields: str, by: tuple[str, ...] = ()) -> DataFrame:
    """before, kept, dropped, and the drops of each pass, in one scan; in all, or for each value of `by`, such as a file."""
    d = F.col("__dropped_at")
    return judged(df, *fields).groupBy(*by).agg(F.count(F.lit(1)).alias("before"), F.count_if(d.isNull()).alias("kept"), F.count(d).alias("dropped"), *[F.count_if(d == n).alias(f"dropped_{n}") for n in range(1, 8)])
