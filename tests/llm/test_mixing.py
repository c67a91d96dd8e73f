import statistics
from collections import Counter

from pyspark.sql import functions as F

from corpusmill.llm import mixing, toxicity


def test_shards_split_quotas_by_the_multivariate_hypergeometric_law(spark):
    quotas = spark.createDataFrame([(1, 40), (2, 120)], "rank int, quota long")
    of_one = []
    for seed in range(10):
        got = mixing.tree(quotas, seed * 1000, 2).collect()
        assert sorted((r["rank"], r["o"]) for r in got) == [(1, o) for o in range(40)] + [(2, o) for o in range(120)]
        assert Counter(r["shard"] for r in got) == {s: 40 for s in range(4)}
        of_one += [sum(r["rank"] == 1 and r["shard"] == s for r in got) for s in range(4)]
    # Drawn without replacement: a mean of 10 and a variance of 40 * 1/4 * 3/4 * 120/159 = 5.7.
    assert statistics.mean(of_one) == 10 and 2.5 < statistics.pvariance(of_one, 10) < 11


def test_every_block_due_has_a_shard_of_its_own_ticket(spark):
    d = spark.range(600).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"), F.lit("clash").alias("shards"), F.lit(1).alias("rank"))
    out = mixing.mix(d, block_docs=8, shard_blocks=1).collect()
    blocks = Counter(s for r in out for s in set(r["shards"]))
    assert len(blocks) > 64 and all(r["taken"] == r["size"] * len(r["shards"]) for r in out)
    assert sorted(mixing.mixed(d, block_docs=8, shard_blocks=1).select("doc_id").collect()) == sorted((r["doc_id"],) for r in out for _ in r["shards"])


def test_the_sample_of_labels_bounds_rows_where_ids_repeat(spark):
    d = spark.range(4_000).select((F.col("id") % 8).alias("doc_id"), F.concat(F.lit("scumbag number "), "id").alias("text"))
    labels = spark.range(8).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    counted = []
    real = toxicity.measured
    try:
        toxicity.measured = lambda df, *a: counted.append(df.count()) or real(df, *a)
        toxicity.learn(d, labels, sample_rows=100)
    finally:
        toxicity.measured = real
    assert counted == [100]
