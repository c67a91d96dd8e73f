"""Registered queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions import metrics, rewrite
from corpusmill.operators import cleaning, dedup, evaluation, neardup, perturb, sequences
from corpusmill.operators.stored import spread

_Q: dict = {}
_SQL: dict[str, str] = {}

# SQL for the normal forms; \s of the other engine knows ASCII white space only.
_WS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b]+"
_LIGHT = rf"trim(regexp_replace(lower(coalesce(text, '')), '{_WS}', ' ', 'g'), ' ')"
_STRICT = rf"trim(regexp_replace(regexp_replace({_LIGHT}, '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '{_WS}', ' ', 'g'), ' ')"
_N = f"n as (select doc_id, {_LIGHT} as light, {_STRICT} as strict from documents)"
_H = f"{_N}, h as (select doc_id, sha1(light) as h, doc_id % 5 = 0 as is_test from n)"
_W = f"{_N}, w as (select doc_id, list_filter(string_split(light, ' '), lambda x: x <> '') as w from n)"
_RW = f"w as (select doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '{_WS}', ' ', 'g'), ' '), lambda x: x <> '') as w from documents)"
_SENT = r"s as (select doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \t\r\n]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ') <> '') as s from documents)"
_SIM = f"""{_W}, f as (select doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]) else w end) as f from w),
hh as (select doc_id, ('0x' || substr(md5(f), 17, 16))::ubigint as h from f),
s as (select doc_id, {" + ".join(f"(case when 2 * sum(((h >> {i}) & 1)::integer) > count(*) then {1 << i}::hugeint else 0::hugeint end)" for i in range(64))} as s from hh group by doc_id),
sim as (select n.doc_id, coalesce(s.s, 0) as s from n left join s using (doc_id))"""
_PAIRS = f"""{_SIM}, b as (select doc_id, k, s from sim, (values (0), (1), (2), (3)) as t(k)),
v as (select doc_id, k, case k when 0 then s % 65536 when 1 then (s // 65536) % 65536 when 2 then (s // 4294967296) % 65536 else (s // 281474976710656) % 65536 end as v from b),
c as (select distinct a.doc_id as test_id, z.doc_id as train_id from v a join v z on a.k = z.k and a.v = z.v and a.doc_id % 5 = 0 and z.doc_id % 5 <> 0),
g as (select doc_id, case when strict = '' then [] else list_distinct(list_transform(range(1, greatest(length(strict) - 3, 2)), lambda i: substr(strict, i, 5))) end as g from n where doc_id in (select test_id from c union select train_id from c)),
p as (select test_id, train_id, len(list_intersect(x.g, y.g)) as i, len(x.g) + len(y.g) - len(list_intersect(x.g, y.g)) as u from c join g x on x.doc_id = test_id join g y on y.doc_id = train_id),
pairs as (select test_id, train_id, case when u = 0 then 1.0 else i / u end as score from p)"""


def _query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _split(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "text")
    return d.where("doc_id % 5 = 0"), d.where("doc_id % 5 <> 0")


@_query(f"with {_N} select doc_id, sha1(light) as light_hash, sha1(strict) as strict_hash from n")
def normalize_hash(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.sha1(T.normalize(F.col("text"))).alias("light_hash"), F.sha1(T.normalize(F.col("text"), True)).alias("strict_hash"))


@_query(f"with {_H}, c as (select h, count(*) as c from h group by h) select count(*) filter (where c > 1) as dup_groups, cast(coalesce(sum(c - 1) filter (where c > 1), 0) as bigint) as dup_items from c")
def dup_groups(spark, sf_dir):
    return dedup.dup_groups(dedup.hashed(_t(spark, sf_dir, "documents"), "doc_id", "text"))


@_query(f"with {_H} select h, min(doc_id) as doc_id from h group by h")
def dedup_keep_first(spark, sf_dir):
    return dedup.keep_first(dedup.hashed(_t(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


@_query(f"with {_H}, a as (select h, count(*) as c from h where is_test group by h), b as (select h, count(*) as c from h where not is_test group by h) select cast(coalesce(sum(least(a.c, b.c)), 0) as bigint) as overlap, count(*) as common_keys from a join b using (h)")
def exact_overlap(spark, sf_dir):
    test, train = _split(spark, sf_dir)
    return dedup.exact_overlap(dedup.hashed(test, "doc_id", "text"), dedup.hashed(train, "doc_id", "text"))


@_query(f"with {_SIM} select doc_id, lower(printf('%016x', s::ubigint)) as simhash from sim".replace("printf('%016x', s::ubigint)", "lpad(to_hex(s::ubigint), 16, '0')"))
def simhash64(spark, sf_dir):
    s = neardup.simhash64(_t(spark, sf_dir, "documents"), "doc_id", "text")
    return s.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("simhash"))


@_query(f"with {_PAIRS} select test_id, train_id, cast(floor(score * 1000000) as bigint) as score_ppm from pairs")
def near_dup_pairs(spark, sf_dir):
    test, train = _split(spark, sf_dir)
    return neardup.near_pairs(test, train, "doc_id", "text").select("test_id", "train_id", F.floor(F.col("score") * 1_000_000).cast("long").alias("score_ppm"))


@_query(f"with {_PAIRS} select count(*) as candidates, count(*) filter (where score >= 0.95) as j95, count(*) filter (where score >= 0.9) as j90, count(*) filter (where score >= 0.8) as j80 from pairs")
def leakage_summary(spark, sf_dir):
    test, train = _split(spark, sf_dir)
    return neardup.near_summary(test, train, "doc_id", "text", j95=0.95, j90=0.9, j80=0.8)


@_query(f"""with {_PAIRS}, hd as (select doc_id, sha1(light) as h from n), tr as (select doc_id, h, row_number() over (partition by h order by doc_id) as rn from hd where doc_id % 5 <> 0)
select doc_id, case when rn > 1 then 'internal_dup' when h in (select h from hd where doc_id % 5 = 0) then 'exact' when doc_id in (select train_id from pairs where score >= 0.95) then 'near' else 'kept' end as reason from tr""")
def dedup_reasons(spark, sf_dir):
    test, train = _split(spark, sf_dir)
    near = neardup.near_train_ids(neardup.near_classes(test, train, "doc_id", "text", least=0.95), train, "doc_id", "text", 0.95)
    return dedup.removal_reasons(dedup.hashed(test, "doc_id", "text"), dedup.hashed(train, "doc_id", "text"), near, "doc_id")


@_query("with r as (select length(coalesce(text, '')) as n, row_number() over (order by length(coalesce(text, ''))) - 1 as k, count(*) over () as c from documents) select max(c) as n, max(n) as max_len, cast(sum(n) as bigint) as sum_len, round(cast(sum(n) as bigint) / max(c), 4) as mean_len, max(n) filter (where k = round_even(0.5 * (c - 1), 0)) as p50, max(n) filter (where k = round_even(0.9 * (c - 1), 0)) as p90, max(n) filter (where k = round_even(0.95 * (c - 1), 0)) as p95 from r")
def length_summary(spark, sf_dir):
    """Nearest ranks from counts by length, so no task sorts all rows."""
    from pyspark.sql import Window

    g = _t(spark, sf_dir, "documents").select(F.length(F.coalesce("text", F.lit(""))).cast("long").alias("len")).groupBy("len").agg(F.count(F.lit(1)).alias("c"))
    w = Window.orderBy("len").rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy()))
    at = lambda p: F.min(F.when(F.col("upto") > F.bround(F.lit(p) * (F.col("n") - 1)), F.col("len")))
    return g.agg(F.max("n").alias("n"), F.max("len").alias("max_len"), F.sum(F.col("len") * F.col("c")).alias("sum_len"), F.round(F.sum(F.col("len") * F.col("c")) / F.max("n"), 4).alias("mean_len"), at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.95).alias("p95"))


@_query("with t as (select conv_id, turn, role, row_number() over (partition by conv_id order by turn) - row_number() over (partition by conv_id, role order by turn) as g from conversations where role <> 'user') select conv_id, role, min(turn) as first_turn, count(*) as n from t group by conv_id, role, g")
def llm_segments(spark, sf_dir):
    t = sequences.islands(_t(spark, sf_dir, "conversations").where("role <> 'user'"), "conv_id", "turn", "role")
    return t.groupBy("conv_id", "role", "island").agg(F.min("turn").alias("first_turn"), F.count(F.lit(1)).alias("n")).drop("island")


@_query("with l as (select conv_id, turn, length(text) as v, lag(length(text)) over (partition by conv_id order by turn) as p from conversations) select conv_id, turn, cast(sum(case when v < p then 1 else 0 end) over (partition by conv_id order by turn) as bigint) as chunk from l")
def monotone_chunks(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("v"))
    return sequences.monotone_chunks(c, "conv_id", "turn", "v").select("conv_id", "turn", "chunk")


_RANK = "r as (select doc_id, toxic, row_number() over (partition by toxic order by md5('2027:' || doc_id), doc_id) as rk, count(*) over (partition by toxic) as cnt from labels)"


@_query(f"with {_RANK} select doc_id, toxic, case when rk <= round_even(cnt * 0.1, 0) then 'a' else 'b' end as split from r")
def stratified_split(spark, sf_dir):
    return sequences.stratified_split(_t(spark, sf_dir, "labels"), "toxic", "doc_id", 0.1, "2027")


@_query(f"with {_RANK} select doc_id, toxic, cast(floor((rk - 1) / 6) as bigint) as batch from r where rk <= (select min(cnt) from r)")
def balanced_batches(spark, sf_dir):
    return sequences.balanced_batches(_t(spark, sf_dir, "labels"), "toxic", "doc_id", 6, "2027")


@_query(f"with {_RW} select doc_id, len(w) as n_words, len(list_distinct(w)) as n_distinct, round(len(list_distinct(w)) / (len(w) + 0.00001), 4) as diversity from w")
def lexical_diversity(spark, sf_dir):
    w = _t(spark, sf_dir, "documents").select("doc_id", T.raw_words(F.col("text")).alias("w"))
    d = F.size(F.array_distinct("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_words"), d.cast("long").alias("n_distinct"), F.round(d / (F.size("w") + F.lit(0.00001)), 4).alias("diversity"))


@_query(f"with {_RW}, e as (select doc_id, unnest(w) as x from w), c as (select doc_id, x, count(*) as c from e group by doc_id, x), t as (select *, c / sum(c) over (partition by doc_id) as p from c), h as (select doc_id, round(-sum(p * log2(p)), 4) + 0.0 as entropy from t group by doc_id) select d.doc_id, coalesce(h.entropy, 0.0) as entropy from documents d left join h using (doc_id)")
def word_entropy(spark, sf_dir):
    m = metrics.measured(_t(spark, sf_dir, "documents"), "doc_id", metrics.text_metrics, "text")
    return m.select("doc_id", F.col("word_entropy").alias("entropy"))


@_query("with e as (select doc_id, unnest(string_split(text, '')) as x from documents where text <> ''), c as (select doc_id, x, count(*) as c from e group by doc_id, x), t as (select *, c / sum(c) over (partition by doc_id) as p from c), h as (select doc_id, round(-sum(p * log2(p)), 4) + 0.0 as entropy from t group by doc_id) select d.doc_id, coalesce(h.entropy, 0.0) as entropy from documents d left join h using (doc_id)")
def char_entropy(spark, sf_dir):
    m = metrics.measured(_t(spark, sf_dir, "documents"), "doc_id", metrics.text_metrics, "text")
    return m.select("doc_id", F.col("char_entropy").alias("entropy"))


_ENTROPY = "coalesce(round_even(log2(nullif(len({0}), 0)) - list_sum(list_transform(map_values(list_histogram({0})), lambda c: c * log2(c))) / len({0}), 4), 0) + 0.0"
_BEATS = r"list_transform(w, lambda x: greatest(len(regexp_extract_all(lower(x), '[aeiouyàáâäæèéêëìíîïòóôöœùúûüÿ]+')), regexp_matches(x, '[\p{L}\p{Nl}\p{No}]')::int))"


#: The rows of text_metrics but for the last place: sums of many terms and ties at the fifth place round apart in two engines.
TEXT_METRICS_SQL = rf"""with {_RW}, {_SENT}, x as (select doc_id, w, {_BEATS} as b, list_transform(s, lambda x: len(list_filter(string_split(regexp_replace(x, '{_WS}', ' ', 'g'), ' '), lambda y: y <> ''))) as l, string_split(coalesce(text, ''), '') as ch from w join s using (doc_id) join documents using (doc_id)),
t as (select doc_id, w, list_filter(ch, lambda c: c <> '') as ch, len(w) as n, len(l) as m, coalesce(list_sum(l), 0) as s1, coalesce(list_sum(list_transform(l, lambda y: y * y)), 0) as s2, coalesce(list_sum(b), 0) as b, len(list_filter(b, lambda y: y >= 3)) as hard from x)
select doc_id, round_even(case when m > 1 then sqrt(greatest(0, m * s2 - s1 * s1)) / m / (s1 / m + 0.00001) else 0 end, 4) + 0.0 as sentence_variability, round_even(case when m > 0 then s1 / m else 0 end, 4) + 0.0 as sentence_length, {_ENTROPY.format('ch')} as char_entropy,
round_even(len(list_distinct(w)) / (n + 0.00001), 4) + 0.0 as diversity, {_ENTROPY.format('w')} as word_entropy, round_even(case when n > 0 and m > 0 then 206.835e0 - 1.015e0 * n / m - 84.6e0 * b / n else 0 end::double, 4) + 0.0 as reading_ease,
round_even(case when n > 0 and m > 0 then 0.4e0 * (n / m + 100 * hard / n) else 0 end::double, 4) + 0.0 as fog, round_even(case when n > 0 then b / n else 0 end::double, 4) + 0.0 as syllable_density from t"""


@_query()
def text_metrics(spark, sf_dir):
    """All metrics of one text; syllables are counted by a rule. TEXT_METRICS_SQL gives them within a unit of the last place."""
    return metrics.measured(_t(spark, sf_dir, "documents"), "doc_id", metrics.text_metrics, "text")


@_query()
def pair_metrics(spark, sf_dir):
    """BLEU, ROUGE, distances and overlaps of neighbouring documents, whole texts."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "text")
    p = spread(d).join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("ref")), "doc_id")
    return metrics.measured(p, "doc_id", metrics.pair_metrics, "text", "ref")


@_query(f"with {_SENT}, l as (select doc_id, list_transform(s, lambda x: len(list_filter(string_split(regexp_replace(x, '{_WS}', ' ', 'g'), ' '), lambda y: y <> ''))) as l from s), t as (select doc_id, len(l) as n, coalesce(list_sum(l), 0) as s1, coalesce(list_sum(list_transform(l, lambda x: x * x)), 0) as s2 from l) select doc_id, n as n_sentences, round(case when n = 0 then 0.0 else s1 / n end, 4) as mean_length, round(case when n < 2 then 0.0 else sqrt((n * s2 - s1 * s1)::double) / n / (s1 / n + 0.00001) end, 4) as variability from t")
def sentence_stats(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.transform(T.sentences(F.col("text")), lambda s: F.size(T.raw_words(s)).cast("long")).alias("l"))
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    t = d.select("doc_id", F.size("l").cast("long").alias("n"), add("l").alias("s1"), add(F.transform("l", lambda x: x * x)).alias("s2"))
    n, s1 = F.col("n"), F.col("s1")
    spread = F.try_divide(F.sqrt((n * F.col("s2") - s1 * s1).cast("double")), n) / (F.try_divide(s1, n) + 0.00001)
    return t.select("doc_id", n.alias("n_sentences"), F.round(F.coalesce(F.try_divide(s1, n), F.lit(0.0)), 4).alias("mean_length"), F.round(F.when(n < 2, 0.0).otherwise(spread), 4).alias("variability"))


@_query(f"with {_SENT}, u as (select doc_id, unnest(s) as sentence, unnest(range(len(s))) as i from s) select doc_id || '_' || i as sentence_id, sentence from u")
def sentence_rows(spark, sf_dir):
    """A row for each sentence, numbered within its document."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("i", "sentence"))
    return d.select(F.concat_ws("_", F.col("doc_id").cast("string"), F.col("i").cast("string")).alias("sentence_id"), "sentence")


@_query()
def block_shuffle(spark, sf_dir):
    """Sentences of each document in permuted blocks of half its length."""
    d = spread(_t(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.sentences(F.col("text")).alias("s"))
    return perturb.reordered(d, "s", perturb.block_order, 0.5).select("doc_id", F.array_join("s", " ").alias("shuffled"))


@_query()
def edit_distance_norm(spark, sf_dir):
    """Characters of whole neighbouring turns of a conversation; brute force tests it, for the other engine compares bytes."""
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("x"))
    p = c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("y")), ["conv_id", "turn"])
    return p.select("conv_id", "turn", F.round(T.edit_distance(F.col("x"), F.col("y")), 4).alias("edit_distance"))


@_query(f"with {_W}, p as (select a.doc_id, list_distinct(a.w) as x, list_distinct(b.w) as y from w a join w b on b.doc_id = a.doc_id + 1) select doc_id, len(list_intersect(x, y)) as common, len(x) as n_pred, len(y) as n_ref from p")
def pair_overlap(spark, sf_dir):
    w = _t(spark, sf_dir, "documents").select("doc_id", F.array_distinct(T.words(T.normalize(F.col("text")))).alias("x"))
    p = w.join(w.select((F.col("doc_id") - 1).alias("doc_id"), F.col("x").alias("y")), "doc_id")
    return p.select("doc_id", F.size(F.array_intersect("x", "y")).cast("long").alias("common"), F.size("x").cast("long").alias("n_pred"), F.size("y").cast("long").alias("n_ref"))


@_query("select a.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::double * b.embedding[i])) / sqrt(list_sum(list_transform(a.embedding, lambda x: x::double * x))) / sqrt(list_sum(list_transform(b.embedding, lambda x: x::double * x))), 6) as cosine, round(list_sum(list_transform(range(1, 65), lambda i: abs(a.embedding[i]::double - b.embedding[i]))), 6) as manhattan, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::double - b.embedding[i]) * (a.embedding[i]::double - b.embedding[i])))), 6) as euclidean from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def vector_similarity(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    p = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    l1 = F.aggregate(F.zip_with("x", "y", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: s + v)
    return p.select("vec_id", F.round(T.cosine(F.col("x"), F.col("y")), 6).alias("cosine"), F.round(l1, 6).alias("manhattan"), F.round(T.euclidean(F.col("x"), F.col("y")), 6).alias("euclidean"))


_PROB = "s as (select toxic as label, ((doc_id * 37 + toxic * 23) % 100) / 100.0::double as prob from labels)"


def _scores(spark, sf_dir):
    return _t(spark, sf_dir, "labels").select(F.col("toxic").alias("label"), (((F.col("doc_id") * 37 + F.col("toxic") * 23) % 100) / 100.0).alias("prob"))


@_query(f"with {_PROB} select count(*) filter (where prob >= 0.5 and label = 1) as tp, count(*) filter (where prob >= 0.5 and label = 0) as fp, count(*) filter (where prob < 0.5 and label = 1) as fn, count(*) filter (where prob < 0.5 and label = 0) as tn from s")
def confusion(spark, sf_dir):
    return evaluation.confusion(_scores(spark, sf_dir))


@_query(f"with {_PROB} select round(sum(case when a.prob > b.prob then 1.0 when a.prob = b.prob then 0.5 else 0.0 end) / count(*), 6) as auc from s a, s b where a.label = 1 and b.label = 0")
def auc_rank(spark, sf_dir):
    return evaluation.auc(_scores(spark, sf_dir))


@_query("select i.item_id, d.doc_id from benchmark i join documents d on contains(d.text, i.text) where i.text <> ''")
def benchmark_containment(spark, sf_dir):
    """Protected passages that stand in documents as they are; an empty one stands in none.

    A passage's inner words, all but the first and last, must be words of the document: up to four of them, or the
    first three characters of a passage without inner words, are the key of an equality join before the check.
    """
    w = lambda c: F.split(c, " ")
    items = _t(spark, sf_dir, "benchmark").where("text <> ''").select("item_id", F.col("text").alias("passage"), F.least(F.lit(4), F.size(w(F.col("text"))) - 2).alias("m"))
    items = items.withColumn("key", F.when(F.col("m") > 0, F.array_join(F.slice(w(F.col("passage")), F.lit(2), F.greatest(F.col("m"), F.lit(1))), " ")).otherwise(F.substring("passage", 1, 3)))
    items = items.withColumn("m", F.when(F.col("m") > 0, F.col("m")).otherwise(-F.length("key")))
    docs = _t(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    keyed = None
    for m in sorted(r["m"] for r in items.select("m").distinct().collect()):
        grams = T.ngrams(w(F.col("text")), m) if m > 0 else F.transform(F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1))), lambda i: F.substring("text", i, F.lit(-m)))
        part = docs.select("doc_id", F.explode(F.array_distinct(grams)).alias("key"), F.lit(m).alias("m"))
        keyed = part if keyed is None else keyed.union(part)
    if keyed is None:
        return items.select("item_id", F.lit(0).cast("long").alias("doc_id")).where("false")
    hits = keyed.join(items, ["m", "key"]).select("doc_id", "item_id", "passage").distinct()
    return hits.join(docs, "doc_id").where(F.contains("text", F.col("passage"))).select("item_id", "doc_id")


@_query("with q as (select quantile_cont(length(text), 0.25) as q1, quantile_cont(length(text), 0.75) as q3 from documents) select doc_id, length(text) as n from documents, q where length(text) between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)")
def iqr_filter(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n"))
    q = d.agg(F.percentile("n", F.lit(0.25)).alias("q1"), F.percentile("n", F.lit(0.75)).alias("q3"))
    return d.join(F.broadcast(q)).where("n between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)").select("doc_id", "n")


@_query("with b as (select min(length(text)) as lo, max(length(text)) as hi from documents) select cast(least(49, coalesce(floor((length(text) - lo) * 50 / nullif(hi - lo, 0)), 0)) as bigint) as bin, count(*) as n from documents, b group by 1")
def histogram(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.length("text").alias("x"))
    b = d.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return d.join(F.broadcast(b)).groupBy(F.least(F.lit(49), F.coalesce(F.floor(F.try_divide((F.col("x") - F.col("lo")) * 50, F.col("hi") - F.col("lo"))), F.lit(0))).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))



def _sql_label(c: str) -> str:
    spelled = lambda v: ", ".join(f"'{x}'" for x in v)
    return f"case when lower(trim({c})) in ({spelled(T.HUMAN)}) then 0 when lower(trim({c})) in ({spelled(T.MACHINE)}) then 1 end"


@_query(f"select doc_id, coalesce({_sql_label('lang')}, {_sql_label('source')}, case when lower(trim(source)) in ('abstract', 'document', 'story', 'content') then 0 else 1 end) as y from documents")
def infer_label(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.infer_label([F.col("lang"), F.col("source")], [F.col("source")]).alias("y"))


@_query("select doc_id, case when coalesce(toxic, -1) in (0, 1) then toxic end as from_number, case when cast(quality = 1 as integer) in (0, 1) then cast(quality = 1 as integer) end as from_boolean from labels")
def typed_labels(spark, sf_dir):
    d = _t(spark, sf_dir, "labels")
    return d.select("doc_id", T.normalize_label(F.col("toxic") + F.lit(0.0), "number").alias("from_number"), T.normalize_label(F.col("quality") == 1, "boolean").alias("from_boolean"))


_REASONS = f"""{_PAIRS}, hd as (select doc_id, sha1(light) as h from n), tr as (select doc_id, h, row_number() over (partition by h order by doc_id) as rn from hd where doc_id % 5 <> 0),
rs as (select doc_id, case when rn > 1 then 'internal_dup' when h in (select h from hd where doc_id % 5 = 0) then 'exact' when doc_id in (select train_id from pairs where score >= 0.95) then 'near' else 'kept' end as reason from tr)"""


@_query(f"with {_REASONS} select count(*) as before, count(*) filter (where reason = 'internal_dup') as internal_dup, count(*) filter (where reason = 'exact') as exact, count(*) filter (where reason = 'near') as near, count(*) filter (where reason = 'kept') as after from rs")
def removal_counters(spark, sf_dir):
    return dedup.removal_counters(dedup_reasons(spark, sf_dir))


@_query("select coalesce(d.doc_id, l.doc_id) as doc_id, case when l.doc_id is null then 'left' when d.doc_id is null then 'right' else 'both' end as side from (select distinct doc_id from documents) d full join (select distinct doc_id from labels) l on d.doc_id = l.doc_id")
def set_difference(spark, sf_dir):
    return dedup.set_difference(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"), "doc_id")


@_query(f"with {_PROB}, c as (select count(*) filter (where prob >= 0.5 and label = 1) as tp, count(*) filter (where prob >= 0.5 and label = 0) as fp, count(*) filter (where prob < 0.5 and label = 1) as fn, count(*) filter (where prob < 0.5 and label = 0) as tn from s) select *, round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1 from c")
def detector_scores(spark, sf_dir):
    return evaluation.scores_at(_scores(spark, sf_dir))


@_query(f"with {_PROB}, g as (select prob, count(*) filter (where label = 1) as p, count(*) filter (where label = 0) as n from s group by prob) select prob as threshold, round(sum(p) over (order by prob desc) / sum(p) over (), 6) as tpr, round(sum(n) over (order by prob desc) / sum(n) over (), 6) as fpr from g")
def roc_points(spark, sf_dir):
    return evaluation.roc_points(_scores(spark, sf_dir))


@_query(f"with {_PROB}, t as (select distinct prob from s), x as (select t.prob, (select min(b.prob) from t b where b.prob > t.prob) as nxt from t), m as (select x.prob, count(*) filter (where s.prob >= x.nxt and s.label = 1) as tp, count(*) filter (where s.prob >= x.nxt) as k, count(*) filter (where s.label = 1) as pos from x, s group by x.prob), f as (select prob, case when k = 0 then 1.0 else tp / k end as a, case when k = 0 then 0.0 else tp / pos end as b from m), q as (select prob, round(2 * a * b / (a + b), 9) as f1 from f where a + b > 0) select arg_max(prob, (f1, -prob)) as threshold, round(max(f1), 6) as f1 from q")
def best_f1(spark, sf_dir):
    return evaluation.best_f1(_scores(spark, sf_dir))


@_query("select round(1 / (1 + exp(-ln(greatest(least(prob, 1 - 1e-6), 1e-6) / (1 - greatest(least(prob, 1 - 1e-6), 1e-6))) / 2.0)), 6) as calibrated, doc_id from (select doc_id, ((doc_id * 37 + toxic * 23) % 100) / 100.0::double as prob from labels)")
def temperature(spark, sf_dir):
    d = _t(spark, sf_dir, "labels").select("doc_id", (((F.col("doc_id") * 37 + F.col("toxic") * 23) % 100) / 100.0).alias("prob"))
    return evaluation.temperature(d, 2.0).select("doc_id", F.round("calibrated", 6).alias("calibrated"))


@_query("select round(regr_slope(l_extendedprice, l_quantity), 6) as slope, round(regr_intercept(l_extendedprice, l_quantity), 6) as intercept from lineitem")
def trend(spark, sf_dir):
    return evaluation.trend(_t(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")


@_query("select round(quantile_cont(n_chars, 0.95), 6) as by_percentile, round(quantile_cont(n_chars, 0.5) + 1.5 * (quantile_cont(n_chars, 0.75) - quantile_cont(n_chars, 0.25)), 6) as robust, round(avg(n_chars) + 1.5 * stddev_pop(n_chars), 6) as moment from documents")
def cut_points(spark, sf_dir):
    return evaluation.cut_points(_t(spark, sf_dir, "documents"), "n_chars", 0.95, 1.5, 1.5)


@_query("select round(avg(n_chars), 6) as tail_mean from (select n_chars from documents order by doc_id desc limit 5)")
def tail_mean(spark, sf_dir):
    return evaluation.tail_mean(_t(spark, sf_dir, "documents"), "doc_id", "n_chars")


_RUN = "e as (select turn as epoch, cast(sum(length(text)) as bigint) as value from conversations group by turn)"


@_query(f"with {_RUN}, b as (select *, max(value) over (order by epoch) as best, coalesce(value > max(value) over (order by epoch rows between unbounded preceding and 1 preceding), true) as better from e), r as (select *, sum(better::integer) over (order by epoch) as run from b) select epoch, best, better, row_number() over (partition by run order by epoch) - 1 >= 3 as stop from r")
def early_stopping(spark, sf_dir):
    """Total text by turn number stands for a score by epoch."""
    e = _t(spark, sf_dir, "conversations").groupBy(F.col("turn").alias("epoch")).agg(F.sum(F.length("text")).alias("value"))
    return sequences.early_stopping(e, "epoch", "value", 3).select("epoch", "best", "better", "stop")


@_query("""with r as (select conv_id * 1000 + turn as rid, conv_id, turn, role, case when role = 'user' then 0 else 1 end as y from conversations),
i as (select *, row_number() over (partition by conv_id order by turn) - row_number() over (partition by conv_id, role order by turn) as g from r),
k as (select *, row_number() over (partition by conv_id, role, g order by md5('11:' || rid), rid) as rk from i), a as (select rid, y from k where rk <= 2),
b as (select *, row_number() over (partition by y order by md5('11:' || rid), rid) as rk, count(*) over (partition by y) as c from a) select rid, y from b where rk <= (select min(c) from b)""")
def segment_sample_balance(spark, sf_dir):
    r = _t(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("rid"), "conv_id", "turn", "role", F.when(F.col("role") == "user", 0).otherwise(1).alias("y"))
    return sequences.segment_sample(r, "conv_id", "turn", "role", "y", "rid", 2, "11")


@_query("with w as (select conv_id, max(turn) - min(turn) + 1 as n, min(turn) as lo from conversations group by conv_id) select c.conv_id, c.turn, (c.turn - lo) // 2 as bucket, case (c.turn - lo) % 2 when 0 then 'random' else 'block' end as strategy from conversations c join w using (conv_id) where (c.turn - lo) // 2 < n // 2")
def shuffle_deck(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn")
    lo = c.groupBy("conv_id").agg(F.min("turn").alias("lo"))
    d = c.join(lo, "conv_id").withColumn("chunk", F.col("turn") - F.col("lo"))
    return sequences.deck(d, "conv_id", "chunk", ["random", "block"]).select("conv_id", "turn", "bucket", "strategy")


@_query("with r as (select doc_id, toxic, row_number() over (partition by toxic order by md5('33:' || doc_id), doc_id) as rk from labels) select doc_id, toxic from r where rk <= 50")
def class_pool(spark, sf_dir):
    return sequences.pool(_t(spark, sf_dir, "labels").select("doc_id", "toxic"), "toxic", "doc_id", 100, "33")


@_query("select page_id, array_to_string(list_transform(regexp_extract_all(url, '[0-9]+|[^0-9]+'), lambda x: case when regexp_matches(x, '^[0-9]') then lpad(length(ltrim(x, '0'))::varchar, 10, '0') || ltrim(x, '0') else x end), '') as k from pages")
def natural_sort_key(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", T.natural_key(F.col("url")).alias("k"))


@_query("select conv_id, turn, concat_ws('_', conv_id::varchar, role, substr(md5(text), 1, 8)) as instance_id from conversations")
def instance_ids(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", T.instance_id(F.col("conv_id").cast("string"), F.col("role"), F.col("text")).alias("instance_id"))


_CLEAN = " or ".join("regexp_matches(coalesce(text, ''), '(?i)" + r.replace("'", "''") + "')" for r in T.REFUSALS)


@_query(rf"""with t as (select doc_id, coalesce(text, '') as text from documents) select doc_id, {_CLEAN} as refusal,
length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) < greatest(10, floor(length(text) * 0.05)) as nonword,
md5(translate(text, '“”‘’`´', repeat(chr(34), 2) || repeat(chr(39), 4))) as quotes,
md5(regexp_replace(regexp_replace(regexp_replace(text, '[ \t\r\f\x0b]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')) as tidy,
md5(regexp_replace(text, '[\s\x0b]*\[\d+(?:[-\x{{2013}}]\d+)?\][\.,]?', '', 'g')) as without_references from t""")
def clean_flags(spark, sf_dir):
    """Rules of cleaning: refusals, texts of mostly other signs, plain quotes, tidy space, no reference numbers (as digests)."""
    t = F.coalesce("text", F.lit(""))
    m = lambda c: F.md5(F.encode(c, "UTF-8"))
    return _t(spark, sf_dir, "documents").select("doc_id", T.is_refusal(t).alias("refusal"), T.mostly_nonword(t).alias("nonword"), m(T.plain_quotes(t)).alias("quotes"), m(T.tidy_space(t)).alias("tidy"), m(T.without_reference_numbers(t)).alias("without_references"))


@_query()
def clean_pipeline(spark, sf_dir):
    """The seven passes of cleaning over every text: the cleaned text's digest, or the pass that drops it."""
    d = cleaning.judged(_t(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return d.select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("cleaned"), F.length("text").cast("long").alias("n_chars"), F.col("__dropped_at").alias("dropped_at"))


@_query()
def clean_counters(spark, sf_dir):
    """Over the turns of conversations, which are short: most go for their length."""
    return cleaning.clean_counters(_t(spark, sf_dir, "conversations"), "text")


@_query("with p as (select label, vec_id, embedding as x, lead(embedding) over (partition by label order by vec_id) as y from embeddings where label is not null), c as (select label, list_sum(list_transform(range(1, 65), lambda i: x[i]::double * y[i])) / sqrt(list_sum(list_transform(x, lambda v: v::double * v))) / sqrt(list_sum(list_transform(y, lambda v: v::double * v))) as c from p where y is not null) select label, round(avg(c), 6) as cohesion from c group by label")
def vector_cohesion(spark, sf_dir):
    """Mean cosine of neighbouring vectors of a label; neighbours are met by a window on the id within the label."""
    from pyspark.sql import Window

    e = _t(spark, sf_dir, "embeddings").where("label is not null").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("x"))
    p = e.withColumn("y", F.lead("x").over(Window.partitionBy("label").orderBy("vec_id"))).where("y is not null")
    return p.groupBy("label").agg(F.round(F.avg(T.cosine(F.col("x"), F.col("y"))), 6).alias("cohesion"))


_FILE = "n as (select doc_id, case doc_id % 4 when 0 then source || '-test.jsonl' when 1 then source || '-seed' || (doc_id % 7) || '-train.jsonl' when 2 then source || '.jsonl' else lang || '-seed' || (doc_id % 3) || '-train.jsonl' end as file from documents), f as (select file, case when file like '%-test.jsonl' then regexp_replace(file, '-test.jsonl$', '') when regexp_matches(file, '-seed[0-9]+-train.jsonl$') then regexp_replace(file, '-seed[0-9]+-train.jsonl$', '') else replace(file, '.jsonl', '') end as dataset, case when file like '%-test.jsonl' then 'fixed' when regexp_matches(file, '-seed[0-9]+-train.jsonl$') then regexp_extract(file, '-seed([0-9]+)-train.jsonl$', 1) end as seed, case when file like '%-test.jsonl' then 'test' when regexp_matches(file, '-seed[0-9]+-train.jsonl$') then 'train' else 'other' end as split from n group by all)"


def _files(spark, sf_dir):
    """Names as data sets are stored under, made of the documents' columns."""
    i, src, tail = F.col("doc_id"), F.col("source"), F.lit("-train.jsonl")
    name = F.when(i % 4 == 0, F.concat(src, F.lit("-test.jsonl"))).when(i % 4 == 1, F.concat(src, F.lit("-seed"), (i % 7).cast("string"), tail)).when(i % 4 == 2, F.concat(src, F.lit(".jsonl"))).otherwise(F.concat("lang", F.lit("-seed"), (i % 3).cast("string"), tail))
    return _t(spark, sf_dir, "documents").select(name.alias("file")).distinct().select("file", T.dataset_name(F.col("file")).alias("d")).select("file", "d.*")


@_query(f"with {_FILE} select * from f")
def file_names(spark, sf_dir):
    return _files(spark, sf_dir)


@_query(f"with {_FILE}, tr as (select dataset, seed, file as train from f where split = 'train'), te as (select dataset, max(file) as test from f where split = 'test' group by dataset) select coalesce(tr.dataset, te.dataset) as dataset, seed, train, test, case when test is null then 'missing_test' when train is null then 'missing_train' end as problem from tr full join te on tr.dataset = te.dataset")
def file_pairs(spark, sf_dir):
    return dedup.paired_files(_files(spark, sf_dir))


@_query("""with a as (select doc_id, lang, source, n_chars from documents), b as (select doc_id, lang, case when doc_id % 11 = 0 then upper(source) else source end as source, n_chars + (doc_id % 13 = 0)::int as n_chars from a where doc_id % 7 <> 0 union all select -1 - doc_id, lang, source, n_chars from a where doc_id % 17 = 0)
select coalesce(a.doc_id, b.doc_id) as doc_id, case when b.doc_id is null then 'missing' when a.doc_id is null then 'extra' else 'differs' end as verdict, case when a.doc_id is null or b.doc_id is null then null when a.source is distinct from b.source then 'source' else 'n_chars' end as field
from a full join b on a.doc_id = b.doc_id where a.doc_id is null or b.doc_id is null or a.source is distinct from b.source or a.n_chars is distinct from b.n_chars""")
def record_diff(spark, sf_dir):
    a, i = _t(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), F.col("doc_id")
    b = a.where("doc_id % 7 <> 0").select("doc_id", "lang", F.when(i % 11 == 0, F.upper("source")).otherwise(F.col("source")).alias("source"), (F.col("n_chars") + (i % 13 == 0).cast("int")).alias("n_chars"))
    return dedup.record_diff(a, b.unionByName(a.where("doc_id % 17 = 0").withColumn("doc_id", -1 - i)), "doc_id")


_NESTED_DOCS = "documents as (select (conv_id * 1000 + turn) * 5 + case when conv_id % 10 = 9 then 0 else 1 end as doc_id, text from conversations where text is not null)"
_NESTED = f"""{_NESTED_DOCS}, {_PAIRS}, nr as (select distinct sha1(light) as h from n where doc_id in (select train_id from pairs where score >= 0.8)), cv as (select conv_id, turn, role, coalesce(text, '') as text, sha1({_LIGHT}) as h from conversations where text is not null), te as (select h from cv where conv_id % 10 = 9),
tr as (select conv_id as item, turn, h, true as is_human, '' as role from cv where conv_id % 10 <> 9 and conv_id % 3 = 0 qualify row_number() over (partition by conv_id order by turn) = 1 union all select conv_id, turn, h, false, role from cv where conv_id % 10 <> 9 and conv_id % 3 <> 0),
rk as (select *, row_number() over (partition by is_human, case when is_human then 0 else item end, role, h order by item, turn) as rn from tr),
re as (select item, is_human, case when rn > 1 then 'internal_dup' when h in (select h from te) then 'exact' when h in (select h from nr) then 'near' else 'kept' end as reason from rk)"""


def _nested(spark, sf_dir):
    """Conversations as nested records: every third is a human text, its first turn; the others hold their turns by role."""
    c = _t(spark, sf_dir, "conversations").where("text is not null")
    turns = lambda who: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == who, F.struct("turn", "text")))), lambda x: x["text"])
    roles = [F.struct(F.lit(r).alias("k"), F.create_map(F.lit("direct"), turns(r)).alias("v")) for r in ("user", "assistant", "system")]
    g = c.where("conv_id % 10 <> 9").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"), F.map_from_entries(F.array(*roles)).alias("label"))
    records = g.withColumn("data_type", F.when(F.col("conv_id") % 3 == 0, "document").otherwise("generated"))
    number = (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id")
    test, train = (c.where(w).select(number, "text") for w in ("conv_id % 10 = 9", "conv_id % 10 <> 9"))
    near = neardup.near_classes(test, train, "doc_id", "text", least=0.8).select(F.col("train_h").alias("h"))
    return records, dedup.nested_reasons(dedup.nested_texts(records, "conv_id"), dedup.hashed(c.where("conv_id % 10 = 9"), "conv_id", "text"), near)


@_query(f"with {_NESTED} select (select count(distinct item) from tr) as train_before, " + ", ".join(f"count(*) filter (where is_human = {h} and reason = '{r}') as {w}_{r}" for w, h in (("human", "true"), ("gen", "false")) for r in ("internal_dup", "exact", "near")) + ", (select count(distinct item) from tr) - count(*) filter (where is_human and reason <> 'kept') as train_after from re")
def nested_removal(spark, sf_dir):
    return dedup.nested_counters(*_nested(spark, sf_dir))


@_query(f"with {_NESTED} select item as conv_id, count(*) filter (where reason = 'kept') as n_texts from re group by item having not bool_or(is_human and reason <> 'kept')")
def nested_filtered(spark, sf_dir):
    records, reasons = _nested(spark, sf_dir)
    n = F.aggregate(F.map_values("label"), F.lit(0).cast("long"), lambda a, m: a + F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda b, x: b + F.size(x)))
    return dedup.nested_filtered(records, reasons, "conv_id").select("conv_id", F.when(F.col("data_type") == "document", F.lit(1).cast("long")).otherwise(n).alias("n_texts"))


_OVERLAP = "(select coalesce(sum(least(a.c, b.c)), 0)::bigint from (select {0} as h, count(*) as c from n where doc_id % 5 = 0 group by 1) a join (select {0} as h, count(*) as c from n where doc_id % 5 <> 0 group by 1) b on a.h = b.h)"
_DUPS = "(select coalesce(sum(c - 1), 0)::bigint from (select count(*) as c from n where doc_id % 5 {0} 0 group by light))"


@_query(f"with {_PAIRS} select (select count(*) from n where doc_id % 5 <> 0) as train_n, (select count(*) from n where doc_id % 5 = 0) as test_n, {_DUPS.format('<>')} as train_internal_dup_items_light, {_DUPS.format('=')} as test_internal_dup_items_light, {_OVERLAP.format('light')} as exact_overlap_light, {_OVERLAP.format('strict')} as exact_overlap_strict, count(*) filter (where score >= 0.9) as near_ge_90_pairs, count(*) filter (where score >= 0.8) as near_ge_80_pairs, count(*) as near_candidates_total from pairs")
def leakage_report(spark, sf_dir):
    """The counts of a leakage report's row; every part is one row, so the joins broadcast one row each."""
    test, train = _split(spark, sf_dir)
    h = {(n, s): dedup.hashed(d, "doc_id", "text", s) for n, d in (("test", test), ("train", train)) for s in (False, True)}
    size = lambda d, name: d.agg(F.count(F.lit(1)).alias(name))
    out = size(train, "train_n")
    parts = [size(test, "test_n")]
    parts += [dedup.dup_groups(h[n, False]).select(F.col("dup_items").alias(f"{n}_internal_dup_items_light")) for n in ("train", "test")]
    parts += [dedup.exact_overlap(h["test", s], h["train", s]).select(F.col("overlap").alias(f"exact_overlap_{'strict' if s else 'light'}")) for s in (False, True)]
    near = neardup.near_summary(test, train, "doc_id", "text", near_ge_90_pairs=0.9, near_ge_80_pairs=0.8)
    parts.append(near.withColumnRenamed("candidates", "near_candidates_total"))
    for p in parts:
        out = out.join(F.broadcast(p))
    return out


_METRIC = "m as (select case turn % 3 when 0 then 'ManhattanDist' when 1 then 'EuclideanDist' else 'TokenOverlap' end as metric, case role when 'user' then 't5-base_group_1' else 't5-small_group_2' end as model, length(coalesce(text, ''))::double as value from conversations)"


@_query(f"with {_METRIC} select metric, replace(replace(model, 't5-base_group_', 'Base'), 't5-small_group_', 'Small') as label, round(avg(case metric when 'ManhattanDist' then value / 100 else value / 10 end), 6) as mean from m where metric <> 'TokenOverlap' group by 1, 2")
def figure_means(spark, sf_dir):
    """Lengths of turns stand for metrics of pairs."""
    t = F.col("turn") % 3
    m = _t(spark, sf_dir, "conversations").select(F.when(t == 0, "ManhattanDist").when(t == 1, "EuclideanDist").otherwise("TokenOverlap").alias("metric"), F.when(F.col("role") == "user", "t5-base_group_1").otherwise("t5-small_group_2").alias("model"), F.length(F.coalesce("text", F.lit(""))).cast("double").alias("value"))
    return evaluation.pair_means(m).select("metric", T.model_label(F.col("model"), long=True).alias("label"), F.round("mean", 6).alias("mean"))


@_query("select case quality % 2 when 0 then 'HierarchicalDensity' else 'Other' end as metric, 't5-base_tau_' || (doc_id % 5) as model, round(avg((toxic - quality) * case quality % 2 when 0 then 10.0 else 1.0 end), 6) as mean from labels group by 1, 2")
def figure_deltas(spark, sf_dir):
    """Labels stand for a prediction's and a reference's metrics."""
    d = _t(spark, sf_dir, "labels").select(F.when(F.col("quality") % 2 == 0, "HierarchicalDensity").otherwise("Other").alias("metric"), F.concat(F.lit("t5-base_tau_"), (F.col("doc_id") % 5).cast("string")).alias("model"), F.col("toxic").alias("prediction"), F.col("quality").alias("reference"))
    return evaluation.delta_means(d).withColumn("mean", F.round("mean", 6))


@_query()
def fitted_temperature(spark, sf_dir):
    """Calibrates by the temperature that fits the scores."""
    d = _scores(spark, sf_dir).select("label", "prob")
    return d.agg(F.count(F.lit(1)).alias("n")).withColumn("temperature", F.round(F.lit(evaluation.fit_temperature(d)), 4))


@_query()
def layered_perturbation(spark, sf_dir):
    """Order, syntax and words of whole documents perturbed by the strongest option of each layer."""
    return perturb.layered(_t(spark, sf_dir, "documents"), "doc_id", "text", lambda layer, text, options: options[-1])


@_query()
def all_shuffles(spark, sf_dir):
    """The five shuffles of every sentence of the conversations."""
    c = spread(_t(spark, sf_dir, "conversations").select("conv_id", "turn", "text")).select("conv_id", "turn", F.posexplode(T.sentences(F.col("text"))).alias("i", "sentence"))
    return c.select("conv_id", "turn", "i", rewrite.shuffles(F.concat_ws("_", "conv_id", "turn", "i"), F.col("sentence")).alias("shuffled"))


from corpusmill.plans import language_queries, model_queries, record_queries, report_queries  # noqa: E402, F401  they register themselves above


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
