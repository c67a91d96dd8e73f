"""Queries of pooling and mixing, of the perturbation policy, of early stopping with a margin, of examples and of seeded sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import dedup, neardup, policy, routes, sequences, vectors
from corpusmill.plans.catalogue import _H, _PAIRS, _query, _split, _t

_SOFT = "t as (select {0}, max(s) as top from r group by {0}), w as (select r.*, exp(s - top) as w from r join t using ({0})), p as (select {0}, unnest(x) as x, unnest(range(len(x))) as i, w from w), m as (select {0}, i, sum(w * x) / sum(w) as v from p group by {0}, i)"


@_query(f"""with r as (select label, embedding as x, case when vec_id % 7 = 0 then -1e9 else 0.7 * tanh(0.5 * embedding[1]::double - 0.25 * embedding[2]::double + 0.1) - 1.3 * tanh(embedding[3]::double) + 0.2 end as s from embeddings where label is not null),
{_SOFT.format('label')} select label, i as place, round(v, 6) + 0.0 as value from m""")
def attention_pool(spark, sf_dir):
    """Vectors of a label pooled by a small tanh network's scores; every seventh vector is masked."""
    e = _t(spark, sf_dir, "embeddings").where("label is not null").select("label", F.col("embedding").cast("array<double>").alias("x"), (F.col("vec_id") % 7 != 0).alias("mask"))
    first = F.slice("x", 1, 3)
    e = e.withColumn("score", vectors.attention_scores(first, [[0.5, -0.25, 0.0], [0.0, 0.0, 1.0]], [0.1, 0.0], [0.7, -1.3], 0.2))
    return vectors.attention_pool(e, ["label"], "x", "score", "mask").select("label", F.posexplode("x").alias("place", "value")).withColumn("value", F.round("value", 6) + 0.0)


@_query(f"""with r as (select vec_id // 7 as text_id, embedding as x, (embedding[1]::double - ln(-ln((('0x' || substr(md5('5:' || vec_id), 1, 8))::bigint + 0.5) / 4294967296.0::double))) / 0.5 as s from embeddings), {_SOFT.format('text_id')},
h as (select vec_id // 7 as text_id, arg_max(embedding, {{'s': embedding[1], 'v': -vec_id}}) as h from embeddings group by 1)
select text_id, i as place, round(0.5 * h[i + 1] + 0.5 * v, 6) + 0.0 as value from m join h using (text_id)""")
def option_mix(spark, sf_dir):
    """Seven vectors as a text's options: the best one blended with their mix under keyed noise."""
    e = _t(spark, sf_dir, "embeddings").select("vec_id", F.call_function("div", F.col("vec_id"), F.lit(7).cast("long")).alias("text_id"), F.col("embedding").cast("array<double>").alias("x"))
    e = e.withColumn("logit", F.get("x", F.lit(0)))
    soft = vectors.option_mix(e, ["text_id"], "vec_id", "x", "logit", 0.5, 5).withColumnRenamed("x", "soft")
    hard = e.groupBy("text_id").agg(F.max_by("x", F.struct("logit", -F.col("vec_id"))).alias("hard"))
    m = soft.join(hard, "text_id").select("text_id", F.posexplode(vectors.blended(F.col("hard"), [F.col("soft")])).alias("place", "value"))
    return m.withColumn("value", F.round("value", 6) + 0.0)


@_query()
def policy_perturbation(spark, sf_dir):
    """Whole documents under the options that seeded networks choose, layer by layer."""
    return policy.perturbed(_t(spark, sf_dir, "documents"), "doc_id", "text", policy.seeded_weights(spark))


@_query("""with recursive e as (select conv_id, turn, length(text) as v, row_number() over (partition by conv_id order by turn) as k from conversations where text is not null),
f as (select conv_id, turn, k, v::double as best, true as better, 0 as bad from e where k = 1 union all select e.conv_id, e.turn, e.k, case when e.v > f.best + 20 then e.v else f.best end, e.v > f.best + 20, case when e.v > f.best + 20 then 0 else f.bad + 1 end from f join e on e.conv_id = f.conv_id and e.k = f.k + 1)
select conv_id, turn, best, better, not better and bad >= 2 as stop from f""")
def early_stopping_runs(spark, sf_dir):
    """Conversations as runs and lengths of turns as scores: better by more than 20 characters, patience 2."""
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("v"))
    return sequences.early_stopping_runs(c, "conv_id", "turn", "v", 2, min_delta=20)


@_query(f"with {_H}, x as (select distinct h from h where is_test intersect select distinct h from h where not is_test) select h, row_number() over (order by h) as k from x order by h limit 20")
def overlap_examples(spark, sf_dir):
    """Up to twenty hashes that stand in test and training documents."""
    from pyspark.sql import Window

    test, train = (dedup.hashed(d, "doc_id", "text") for d in _split(spark, sf_dir))
    return dedup.overlap_examples(test, train).withColumn("k", F.row_number().over(Window.orderBy("h")).cast("long"))  # of twenty rows


@_query(f"with {_PAIRS} select test_id, train_id, round(score, 4) as score from pairs where score >= 0.9 order by test_id, train_id limit 20")
def near_examples(spark, sf_dir):
    test, train = _split(spark, sf_dir)
    return neardup.near_examples(test, train, "doc_id", "text")


@_query("""with r as (select doc_id, toxic, row_number() over (partition by toxic order by md5('202401:' || doc_id), doc_id) as rk from labels), p as (select doc_id, toxic from r where rk <= 3000),
q as (select *, row_number() over (partition by toxic order by md5('202401:' || doc_id), doc_id) as rk, count(*) over (partition by toxic) as c from p), s as (select doc_id, rk <= round_even(c * 0.4, 0) as is_test from q),
e as (select 'test' as split, '202401' as seed, doc_id from s where is_test union all select 'train', seed, doc_id from s, (values ('11'), ('22'), ('33')) as t(seed) where not is_test)
select split, seed, row_number() over (partition by split, seed order by md5(seed || ':' || doc_id), doc_id) as position, doc_id from e""")
def seeded_sets(spark, sf_dir):
    """A fixed test set, and the same training rows in the order of three seeds."""
    return sequences.seeded_sets(_t(spark, sf_dir, "labels").select("doc_id", "toxic"), "toxic", "doc_id")


@_query("with r as (select doc_id, row_number() over (order by md5('42:' || doc_id), doc_id) as rk, count(*) over () as c from documents) select doc_id, case when rk <= round_even(c * 0.8, 0) then 'a' else 'b' end as split from r")
def random_split(spark, sf_dir):
    """Four fifths of all documents by a seeded hash, and the rest."""
    return sequences.random_split(_t(spark, sf_dir, "documents"), "doc_id")


_DECK = ", ".join(f"'{x}'" for x in sequences.DECK_1)


@_query(f"""with c as (select doc_id, doc_id % 3 as part, doc_id // 6 as chunk from documents), w as (select part, (max(chunk) + 1) // 10 as whole from c group by part), b as (select c.*, chunk // 10 as bucket from c join w using (part) where chunk // 10 < whole),
k as (select distinct part, bucket from b), o as (select part, bucket, j, row_number() over (partition by part, bucket order by md5('42:' || part || ':' || bucket || ':' || j)) as place from k, range(10) as t(j))
select doc_id, b.bucket, [{_DECK}][place] as strategy from b join o on o.part = b.part and o.bucket = b.bucket and o.j = chunk % 10""")
def dealt_decks(spark, sf_dir):
    """Documents in chunks, every ten of which are dealt the shuffled strategies."""
    i = F.col("doc_id")
    c = _t(spark, sf_dir, "documents").select("doc_id", (i % 3).alias("part"), F.call_function("div", i, F.lit(6).cast("long")).alias("chunk"))
    return sequences.dealt(c, "part", "chunk").select("doc_id", "bucket", "strategy")


@_query()
def joint_scores(spark, sf_dir):
    """Vectors, their mirror images and their turned copies as the three routes of a deep seeded classifier, with four figures of each as metrics."""
    e = _t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    e = e.select("vec_id", F.col("x").alias("original_vector"), F.reverse("x").alias("perturbed_vector"), F.concat(F.slice("x", 9, 999), F.slice("x", 1, 8)).alias("restored_vector"))
    for r in routes.ROUTES:
        x = F.col(f"{r}_vector")
        e = e.withColumn(f"{r}_metrics", F.array(F.get(x, F.lit(0)), F.array_max(x), F.array_min(x), F.aggregate(x, F.lit(0.0), lambda a, v: a + v)))
    model = routes.load(routes.seeded_weights(spark, 68, 32, 64, depth=3), depth=3)
    return routes.classified(e, "vec_id", model)
