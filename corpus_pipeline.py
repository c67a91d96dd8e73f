"""The corpus pipeline: toxicity, n-gram Jaccard join, mixing to target weights, SentencePiece encoding."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import mixing, ngram_join, pieces, toxicity
from corpusmill.llm.common import erase, shared_dir, table, written

#: Rows are told apart by this column, which a stage writes with them: ids may repeat or be null.
ROW = "__row"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows not predicted toxic; null and empty texts are clean."""
    return toxicity.clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each group linked by shingle Jaccard of 0.8 or more over five-word shingles; rows without words all stay."""
    rows = written(docs.withColumn(ROW, F.monotonically_increasing_id()))
    groups = ngram_join.ngram_jaccard_components(rows, id_col=ROW, k=5, percent=80)
    return rows.join(written(groups.where(F.col("component_id") != F.col(ROW)).select(ROW)), ROW, "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, by shard and shuffled within: a row for each time it takes a document."""
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", keep_one_of_each_group), ("mixing", mix_sources), ("sentencepiece", encode_pieces)]

#: Learned scores, similarity classes, keyed draws and merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, base, last = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if last:
            erase(spark, f"{base}/{last}")
        last = name
    return docs
