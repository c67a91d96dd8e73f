"""Queries of test rows, of reports for each data set, and of small projections and limits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions import metrics
from corpusmill.functions import text as T
from corpusmill.operators import building, cleaning, dedup, evaluation
from corpusmill.plans.catalogue import _PAIRS, _PROB, _SENT, _query, _scores, _split, _t

_SHAPES = """select doc_id as ord, 'f' || doc_id % 3 as file, text, source, lang, n_chars, doc_id % 8 as k from documents"""


@_query(f"""with s as ({_SHAPES}), r as (select file, ord, case k when 0 then coalesce(text, '') when 1 then coalesce(source, '') when 2 then coalesce(lang, '') when 3 then '' when 4 then coalesce(text, '') when 5 then 'plain' when 6 then n_chars::varchar else '' end as t,
case k when 0 then 0 when 1 then 0 when 2 then 1 when 3 then 0 when 4 then 1 when 5 then 1 when 6 then 0 else 1 end as label, k <> 5 as is_object, k in (4, 5, 6, 7) as missing_label from s)
select file, ord, md5(t) as digest, label, is_object and t = '' as empty_text, missing_label from r""")
def test_rows(spark, sf_dir):
    """Documents as records of eight shapes, made rows of text and label."""
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.concat(F.lit("f"), (F.col("doc_id") % 3).cast("string")).alias("file"), "text", "source", "lang", "n_chars", (F.col("doc_id") % 8).alias("k"))
    full = lambda c: F.coalesce(c, F.lit(""))
    obj = lambda **a: F.to_json(F.struct(*[(v if isinstance(v, F.Column) else F.lit(v)).alias(n) for n, v in a.items()]))
    shapes = [
        obj(text=full("text"), label="human"),
        obj(content=full("source"), label=0.7),
        obj(abstract=full("lang"), label=True),
        obj(text="", content=full("source"), label="??", data_type=" Story "),
        obj(document=full("text"), category="news", y="AI"),
        F.lit('"plain"'),
        obj(story=F.col("n_chars"), type="content"),
        F.lit('{"text":null,"body":1}'),
    ]
    j = F.coalesce(*[F.when(F.col("k") == i, s) for i, s in enumerate(shapes)])
    r = building.test_rows(d.select("file", "ord", F.parse_json(j).alias("record")))
    return r.select("file", "ord", F.md5(F.encode("text", "UTF-8")).alias("digest"), "label", "empty_text", "missing_label")


_BY = "src as (select doc_id, source from documents where source is not null), ns as (select n.*, source, doc_id % 5 = 0 as is_test from n join src using (doc_id)), ps as (select p.*, a.source from pairs p join src a on a.doc_id = test_id join src b on b.doc_id = train_id and b.source = a.source)"


@_query(f"""with {_PAIRS}, {_BY}, l as (select source, light, count(*) filter (where not is_test) as a, count(*) filter (where is_test) as b from ns group by 1, 2), t as (select source, strict, count(*) filter (where not is_test) as a, count(*) filter (where is_test) as b from ns group by 1, 2),
x as (select source, sum(a)::bigint as train_n, sum(b)::bigint as test_n, sum(greatest(a - 1, 0))::bigint as train_internal_dup_items_light, sum(greatest(b - 1, 0))::bigint as test_internal_dup_items_light, sum(least(a, b))::bigint as exact_overlap_light from l group by 1),
y as (select source, sum(least(a, b))::bigint as exact_overlap_strict from t group by 1), z as (select source, count(*) as c, count(*) filter (where score >= 0.9) as j90, count(*) filter (where score >= 0.8) as j80 from ps group by 1)
select x.*, exact_overlap_strict, coalesce(c, 0) as near_candidates_total, coalesce(j90, 0) as near_ge_90_pairs, coalesce(j80, 0) as near_ge_80_pairs from x join y using (source) left join z using (source)""")
def leakage_by_source(spark, sf_dir):
    """The leakage report's row for each source: its test documents against its training documents."""
    test, train = (d.join(_t(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id") for d in _split(spark, sf_dir))
    return dedup.leakage_by(test, train, "source", "doc_id", "text")


@_query(f"""with {_PAIRS}, {_BY}, tr as (select doc_id, source, light, row_number() over (partition by source, light order by doc_id) as rn from ns where not is_test), te as (select distinct source, light from ns where is_test),
nr as (select distinct source, train_id from ps where score >= 0.95), r as (select tr.source, case when rn > 1 then 'i' when te.light is not null then 'e' when nr.train_id is not null then 'n' else 'k' end as k from tr left join te on te.source = tr.source and te.light = tr.light left join nr on nr.train_id = tr.doc_id)
select source, count(*) as train_before, count(*) filter (where k = 'i') as train_internal_dup_removed, count(*) filter (where k = 'e') as train_test_exact_removed, count(*) filter (where k = 'n') as train_test_near_removed, count(*) filter (where k = 'k') as train_after from r group by 1""")
def removal_by_source(spark, sf_dir):
    """The removal report's row for each source."""
    test, train = (d.join(_t(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id") for d in _split(spark, sf_dir))
    return dedup.removal_by(test, train, "source", "doc_id", "text")


@_query()
def clean_counters_by_role(spark, sf_dir):
    """Turns of conversations in, kept and dropped for each role, which stands for a file."""
    return cleaning.clean_counters(_t(spark, sf_dir, "conversations"), "text", by=("role",))


@_query("with n as (select len(list_filter(string_split(trim(regexp_replace(coalesce(text, ''), '[ \t\r\n]+', ' ', 'g'), ' '), ' '), lambda x: x <> '')) as n from documents) select n // 100 * 100 as lo, count(*) as n, (select round(avg(n), 4) from n) as mean from n group by 1")
def length_bins(spark, sf_dir):
    """Words of documents in bins of a hundred, and their mean."""
    w = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), "[ \t\r\n]+"), ""))
    return evaluation.whole_bins(_t(spark, sf_dir, "documents").select(w.alias("w")), "w", 100).withColumn("mean", F.round("mean", 4))


@_query(f"with {_PROB} select count(*) filter (where prob > 0.5 and label = 1) as tp, count(*) filter (where prob > 0.5 and label = 0) as fp, count(*) filter (where prob <= 0.5 and label = 1) as fn, count(*) filter (where prob <= 0.5 and label = 0) as tn from s")
def confusion_exclusive(spark, sf_dir):
    """A score at the threshold counts as 0."""
    return evaluation.confusion(_scores(spark, sf_dir), inclusive=False)


@_query("with v as (select vec_id, case when vec_id % 50 = 0 then 'nan'::double when vec_id % 51 = 0 then 'inf'::double when vec_id % 52 = 0 then null else embedding[1]::double * case when vec_id % 9 = 0 then 9 else 1 end end as v from embeddings), f as (select * from v where isfinite(v)), q as (select quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.75) as q3 from f) select vec_id, v from f, q where v between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)")
def finite_without_outliers(spark, sf_dir):
    """First components of vectors, some of them not finite or far out."""
    i, x = F.col("vec_id"), F.get("embedding", F.lit(0)).cast("double")
    v = F.when(i % 50 == 0, float("nan")).when(i % 51 == 0, float("inf")).when(i % 52 == 0, None).otherwise(x * F.when(i % 9 == 0, 9).otherwise(1))
    return evaluation.without_outliers(_t(spark, sf_dir, "embeddings").select("vec_id", v.alias("v")), "v")


_RAW = "n as (select distinct source || case doc_id % 4 when 0 then '_train.json' when 1 then '_test.json' when 2 then '.json' else lang || '_train.json' end as file from documents where source is not null and lang is not null)"


@_query(f"with {_RAW}, p as (select regexp_extract(file, '^(.*)_(train|test)[.]json$', 1) as prefix, regexp_extract(file, '^(.*)_(train|test)[.]json$', 2) as split, file from n) select prefix, max(file) filter (where split = 'train') as train, max(file) filter (where split = 'test') as test, case when count(*) filter (where split = 'test') = 0 then 'missing_test' when count(*) filter (where split = 'train') = 0 then 'missing_train' end as problem from p where prefix <> '' group by 1")
def raw_pairs(spark, sf_dir):
    """Raw training files and their test files by name."""
    i = F.col("doc_id") % 4
    name = F.concat("source", F.when(i == 0, "_train.json").when(i == 1, "_test.json").when(i == 2, ".json").otherwise(F.concat("lang", F.lit("_train.json"))))
    f = _t(spark, sf_dir, "documents").where("source is not null and lang is not null").select(name.alias("file")).distinct()
    f = f.select("file", T.raw_pair_name(F.col("file")).alias("p")).select("file", F.col("p.prefix").alias("dataset"), F.lit(None).cast("string").alias("seed"), "p.split")
    return dedup.paired_files(f.where("split is not null")).select(F.col("dataset").alias("prefix"), "train", "test", "problem")


@_query("select conv_id, turn, 'reorder: ' || coalesce(text, '') as prompt from conversations where conv_id % 10 in (1, 4, 7)")
def reorder_prompts(spark, sf_dir):
    """Prompts of the instances whose group is wanted."""
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.struct((F.col("conv_id") % 10).alias("group_id")).alias("metadata"))
    return c.where(F.col("metadata.group_id").isin(1, 4, 7)).select("conv_id", "turn", F.concat(F.lit("reorder: "), F.coalesce("text", F.lit(""))).alias("prompt"))


@_query("""with a as (select conv_id, row_number() over (partition by conv_id order by turn) as k, turn from conversations where role = 'user'), b as (select conv_id, row_number() over (partition by conv_id order by turn) as k, turn from conversations where role = 'assistant')
select conv_id, a.k - 1 as place, a.turn as asked, b.turn as answered from a join b using (conv_id, k)""")
def positional_zip(spark, sf_dir):
    """A conversation's questions and answers side by side by their places; the longer list is cut."""
    c = _t(spark, sf_dir, "conversations")
    turns = lambda who: F.array_sort(F.collect_list(F.when(F.col("role") == who, F.col("turn"))))
    g = c.groupBy("conv_id").agg(turns("user").alias("asked"), turns("assistant").alias("answered"))
    n = F.least(F.size("asked"), F.size("answered"))
    cut = lambda x: F.slice(x, F.lit(1), n)
    return g.select("conv_id", F.posexplode(F.arrays_zip(cut("asked").alias("asked"), cut("answered").alias("answered"))).alias("place", "z")).select("conv_id", "place", "z.asked", "z.answered")


@_query("select doc_id, n_chars from documents where n_chars is not null order by n_chars desc, doc_id limit 10")
def longest_texts(spark, sf_dir):
    """The ten longest documents; each task keeps its own ten before they meet."""
    return _t(spark, sf_dir, "documents").where("n_chars is not null").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(10)


@_query("select file, row_number() over (order by dataset, try_cast(seed as bigint), file) as place from (select distinct source || '-seed' || doc_id % 12 || '-train' as file, source as dataset, (doc_id % 12)::varchar as seed from documents where source is not null)")
def sorted_files(spark, sf_dir):
    """Names of training files by data set, then by seed as a number."""
    name = F.concat("source", F.lit("-seed"), (F.col("doc_id") % 12).cast("string"), F.lit("-train"))
    f = _t(spark, sf_dir, "documents").where("source is not null").select(name.alias("file")).distinct()
    f = f.select("file", T.dataset_name(F.col("file")).alias("d"))
    return f.select("file", F.row_number().over(Window.orderBy("d.dataset", F.col("d.seed").try_cast("long"), "file")).cast("long").alias("place"))  # of names, a few hundred


@_query(f"with {_SENT} select doc_id, array_to_string(s[1:8], chr(10)) as head, len(s) as n_sentences from s")
def first_sentences(spark, sf_dir):
    """The first eight sentences of documents."""
    d = _t(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return d.select("doc_id", F.array_join(F.slice("s", 1, 8), "\n").alias("head"), F.size("s").cast("long").alias("n_sentences"))


@_query("""with d as (select role as model, turn % 2 as m, avg(length(coalesce(text, ''))) as v from conversations group by 1, 2)
select case m when 0 then 'ManhattanDist' else 'BLEU' end as metric, round(max(case when model = 'user' then v end) / case m when 0 then 100 else 1 end, 6) as user, round(max(case when model = 'assistant' then v end) / case m when 0 then 100 else 1 end, 6) as assistant from d group by m""")
def figure_table(spark, sf_dir):
    """Mean lengths of turns as two metrics of two models side by side."""
    c = _t(spark, sf_dir, "conversations").select(F.when(F.col("turn") % 2 == 0, "ManhattanDist").otherwise("BLEU").alias("metric"), F.col("role").alias("model"), F.length(F.coalesce("text", F.lit(""))).cast("double").alias("value"))
    m = evaluation.mean_table(c, ["user", "assistant"])
    return m.select("metric", *[F.round(x, 6).alias(x) for x in ("user", "assistant")])


@_query()
def pair_report(spark, sf_dir):
    """Metrics of neighbouring turns of a conversation and of either turn for itself."""
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    p = c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("ref")), ["conv_id", "turn"])
    return metrics.measured(p.withColumn("id", F.concat_ws("_", "conv_id", "turn")), "id", metrics.pair_report, "text", "ref")
