"""The operators' queries over the driver's tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chats, embedding_dedup, late_arrivals, licenses, media, mixing, ngram_join, pieces, quality_rules, spelling, toxicity, url_lists, warc
from .common import table


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.audio_features(table(spark, sf_dir, "documents")))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"), licenses.digest_table(spark))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    lexicon = toxicity.learn(documents, table(spark, sf_dir, "labels"))
    return toxicity.toxicity(documents, lexicon)


def list_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of pages and the domains above them: up to three changes each, by digest of the domain."""
    host = pages.select(url_lists.host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    domain = host.select(F.explode(url_lists.domains_of(F.col("host"))).alias("domain")).distinct().where(F.contains("domain", F.lit(".")))
    step = domain.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    h = F.conv(F.substring(F.md5(F.encode(F.concat_ws(":", "domain", F.col("k").cast("string")), "UTF-8")), 1, 7), 16, 10).cast("long")
    dated = step.withColumn("h", h).where("h % 4 <> 0")
    return dated.select("domain", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("h") % 700).cast("int")).alias("date"), F.when(F.col("k") == 1, "remove").otherwise("add").alias("action"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(730)).cast("int")))
    out = url_lists.temporal_list_join(captures, list_entries(pages))
    return out.select("page_id", "host", F.col("fetched").cast("string").alias("fetched"), F.col("blocked").cast("int").alias("blocked"), "matched_domain", F.col("listed_since").cast("string").alias("listed_since"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_neighbours(table(spark, sf_dir, "embeddings"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shards")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.collapse_snapshots(table(spark, sf_dir, "conversations"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_components(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = warc.round_trip(table(spark, sf_dir, "pages"))
    number = lambda c: F.nullif(F.regexp_extract(c, r":(-?\d*)>$", 1), F.lit("")).cast("long")
    return r.select(number(F.col("record_id")).alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", number(F.col("refers_to")).alias("refers_to"), F.col("request").isNotNull().alias("has_request"), F.col("metadata").isNotNull().alias("has_metadata"))


def op11_late_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return late_arrivals.overwritten(table(spark, sf_dir, "sales"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spelling.word_counts(table(spark, sf_dir, "documents"), respell=spelling.with_a_slip))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measured_rules(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_media_columns, op2_license_scans, op3_toxicity, op4_url_filters, op5_embedding_near_dedup, op6_mixing, op7_sentencepiece, op8_chat_formatting, op9_ngram_jaccard_join, op10_warc, op11_late_arrivals, op12_spelling_variants, op13_quality_rules)}


def _sql_canonical() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + licenses.SIGNS[0], "abcdefghijklmnopqrstuvwxyz" + licenses.SIGNS[1]
    c = f"translate(coalesce(text, ''), {q(upper)}, {q(lower)})"
    c = f"regexp_replace({c}, {q(licenses.COPYRIGHT_LINE)}, chr(10), 'g')"
    c = f"trim(regexp_replace({c}, {q(licenses.BETWEEN)}, ' ', 'g'), ' ')"
    for pattern, to in licenses.SPELLINGS:
        c = f"regexp_replace({c}, {q(pattern)}, {q(to.replace('$', chr(92)))}, 'g')"
    return c


OP4_SQL = r"""
with h as (select page_id, cast('2024-01-01' as date) + cast((page_id * 37) % 730 as integer) as fetched, nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9a-f:.]+\]|[^/?#:@\[\]]+)', 1), '^\[|\]$|\.$', '', 'g'), '') as host from pages),
hosts as (select distinct host, case when regexp_matches(host, '^[0-9.]+$|:') then [host] else string_split(host, '.') end as p from h where host is not null),
up as (select host, array_to_string(p[i:], '.') as domain from (select host, p, unnest(range(1, len(p) + 1)) as i from hosts)),
dom as (select distinct domain from up where contains(domain, '.')),
ev as (select domain, k, ('0x' || substr(md5(domain || ':' || k), 1, 7))::bigint as x from dom, (values (0), (1), (2)) as t(k)),
entries as (select domain, cast('2024-01-01' as date) + cast(x % 700 as integer) as d, k <> 1 as is_add from ev where x % 4 <> 0),
days as (select domain, d, max(case when is_add then 1 else 0 end) as is_on from entries group by domain, d),
turns as (select * from (select *, coalesce(lag(is_on) over (partition by domain order by d), 0) as was from days) where is_on <> was),
spans as (select domain, d as valid_from, valid_until from (select *, lead(d) over (partition by domain order by d) as valid_until from turns) where is_on = 1),
hits as (select page_id, s.domain, s.valid_from, row_number() over (partition by page_id order by length(s.domain) desc) as rn from h join up using (host) join spans s on s.domain = up.domain and s.valid_from <= fetched and (s.valid_until is null or fetched < s.valid_until))
select h.page_id, h.host, cast(h.fetched as varchar) as fetched, case when hits.page_id is null then 0 else 1 end as blocked, hits.domain as matched_domain, cast(hits.valid_from as varchar) as listed_since
from h left join hits on hits.page_id = h.page_id and hits.rn = 1"""

OP8_SQL = """
with t as (select *, row_number() over (partition by conv_id order by turn, role, text) as pos, count(*) over (partition by conv_id) as n from conversations where conv_id is not null),
p as (select conv_id, pos, n, string_agg(coalesce('=' || role, '') || chr(1) || coalesce('=' || text, '') || chr(2), '') over (partition by conv_id order by pos) as s,
  string_agg('<|im_start|>' || replace(coalesce(role, ''), '<|im_', '<|' || chr(8203) || 'im_') || chr(10) || replace(coalesce(text, ''), '<|im_', '<|' || chr(8203) || 'im_') || '<|im_end|>' || chr(10), '') over (partition by conv_id order by pos) as rendered from t),
w as (select s, n, min(conv_id) as conv_id, count(*) as copies from p where pos = n group by s, n)
select w.conv_id, w.n as n_turns, w.copies, p.rendered from w join p on p.conv_id = w.conv_id and p.pos = p.n
where not exists (select 1 from p q where q.pos < q.n and q.pos = w.n and q.s = w.s)"""


def oracle_sql() -> dict[str, str]:
    values = ", ".join(f"('{d}', '{k}')" for d, k in licenses.known_digests())
    return {
        "op2_license_scans": f"with c as (select doc_id, {_sql_canonical()} as c from documents), d as (select doc_id, length(c) as canonical_chars, sha256(c) as digest from c) select d.doc_id, d.canonical_chars, d.digest, k.license from d left join (values {values}) as k(digest, license) on k.digest = d.digest",
        "op4_url_filters": OP4_SQL,
        "op8_chat_formatting": OP8_SQL,
        "op13_quality_rules": quality_rules.sql(),
    }
