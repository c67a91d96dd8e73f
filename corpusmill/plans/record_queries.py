"""Queries over record files in their wrappers."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators.stored import shared_folder
from corpusmill.plans.catalogue import _query, _t
from corpusmill.sources import records


def _page_files(spark, sf_dir):
    """file, value: pages as JSON texts, ten to a list or to a {"data": [...]} with other fields, or each for itself; labels are numbers or objects."""
    p = _t(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("text"))
    k = F.call_function("div", F.col("page_id"), F.lit(10).cast("long"))
    plain, nested = (F.to_json(F.struct("page_id", "text", x.alias("label"))) for x in (F.lit(1), F.struct(F.lit(1).alias("m"))))
    p = p.select("page_id", k.alias("k"), F.when(k % 2 == 0, plain).otherwise(nested).alias("j"))
    kind = F.element_at(F.array(F.lit("list"), F.lit("data"), F.lit("single")), (F.col("k") % 3 + 1).cast("int"))
    p = p.withColumn("kind", kind).withColumn("file", F.concat_ws("-", "kind", F.when(F.col("kind") == "single", F.col("page_id")).otherwise(F.col("k")).cast("string")))
    g = p.groupBy("file", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "j"))), lambda x: x["j"]), ",").alias("j"))
    return g.select("file", F.when(F.col("kind") == "list", F.concat(F.lit("["), "j", F.lit("]"))).when(F.col("kind") == "data", F.concat(F.lit('{"name":"n","data":['), "j", F.lit('],"v":[1]}'))).otherwise(F.col("j")).alias("value"))


@_query("""with p as (select page_id, coalesce(html, '') as text, page_id // 10 as k from pages), q as (select *, ['list', 'data', 'single'][k % 3 + 1] as wrapper from p),
f as (select *, wrapper || '-' || case when wrapper = 'single' then page_id else k end as file from q)
select file, row_number() over (partition by file order by page_id) - 1 as ord, wrapper, case when wrapper = 'data' then '{"name":"n","v":[1]}' end as envelope, case when k % 2 = 0 then 'flat' else 'nested' end as format, page_id, md5(text) as digest from f""")
def wrapped_records(spark, sf_dir):
    """Records of JSON texts in three wrappers, with the format that a file's first record shows."""
    files = _page_files(spark, sf_dir)
    r = records.records_of(files)
    page, text = F.try_variant_get("record", "$.page_id", "long"), F.try_variant_get("record", "$.text", "string")
    out = r.join(records.wrappers(files), "file").join(records.file_formats(r), "file")
    return out.select("file", "ord", "wrapper", "envelope", "format", page.alias("page_id"), F.md5(F.encode(text, "UTF-8")).alias("digest"))


@_query("""with a as (select doc_id, lang, source, n_chars, doc_id % 37 as r, doc_id // 37 as ord from documents),
base as (select 'f' || r as file, ord, doc_id, lang, source, n_chars, null as extra from a),
target as (select case when r = 4 then 'g4' else 'f' || r end as file, ord, doc_id, lang, case when r = 5 and ord % 5 = 2 then upper(source) else source end as source,
case when r = 8 and ord % 3 = 1 then n_chars + 1 else n_chars end as n_chars, case when r = 7 and ord % 4 = 3 then 1 end as extra from a where r <> 3 and not (r = 6 and ord % 7 = 1)),
ca as (select file, count(*) as n from base group by file), cb as (select file, count(*) as n from target group by file),
d as (select file, min({'ord': ord, 'what': case when b.extra is not null then 'keys' when a.n_chars is distinct from b.n_chars then 'n_chars' else 'source' end}) as x
from base a join target b using (file, ord) where b.extra is not null or a.n_chars is distinct from b.n_chars or a.source is distinct from b.source group by file)
select file, case when cb.n is null then 'missing' when ca.n is null then 'extra' when ca.n <> cb.n or d.x is not null then 'differs' else 'equal' end as verdict, coalesce(ca.n, 0) as n_base, coalesce(cb.n, 0) as n_target,
case when ca.n = cb.n then d.x.ord end as first_ord, case when ca.n <> cb.n then 'count' else d.x.what end as differs_in from ca full join cb using (file) left join d using (file)""")
def directory_diff(spark, sf_dir):
    """Documents as 37 files of records, against a copy where files are gone, renamed, shorter or changed in places."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", (F.col("doc_id") % 37).alias("r"), F.call_function("div", F.col("doc_id"), F.lit(37).cast("long")).alias("ord"))
    r, at = F.col("r"), F.col("ord")
    name = F.concat(F.lit("f"), r.cast("string"))
    record = lambda *more: F.parse_json(F.to_json(F.struct("doc_id", "lang", "source", "n_chars", *more)))
    base = d.select(name.alias("file"), "ord", record().alias("record"))
    t = d.where((r != 3) & ~((r == 6) & (at % 7 == 1)))
    t = t.withColumn("source", F.when((r == 5) & (at % 5 == 2), F.upper("source")).otherwise(F.col("source"))).withColumn("n_chars", F.when((r == 8) & (at % 3 == 1), F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    target = t.select(F.when(r == 4, "g4").otherwise(name).alias("file"), "ord", record(F.when((r == 7) & (at % 4 == 3), 1).alias("extra")).alias("record"))
    return records.directory_diff(base, target)


@_query()
def line_limit(spark, sf_dir):
    """Conversations written as lines with blank and broken ones between, in a new shared folder; the first 100 lines of each file read back."""
    import uuid

    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    c = _t(spark, sf_dir, "conversations").withColumn("file", F.col("conv_id") % 3)
    line = F.to_json(F.struct("conv_id", "turn", "role"))
    c = c.select("file", F.explode(F.array(line, F.when(F.col("turn") % 3 == 0, "").when(F.col("turn") % 3 == 1, F.concat(line, F.lit("}{"))))).alias("line")).where("line is not null")
    c.repartition("file").write.partitionBy("file").text(path)
    r = records.read_lines(spark, path, 100)
    return r.select(F.regexp_extract("file", "file=([0-9]+)", 1).cast("long").alias("file"), "ord", F.try_variant_get("record", "$.conv_id", "long").alias("conv_id"), F.try_variant_get("record", "$.turn", "long").alias("turn"))
