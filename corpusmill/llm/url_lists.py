"""URL filters by dated lists: entries become validity intervals, captures are judged by those in force at fetch time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written


def host_of(url) -> F.Column:
    """The lower-case host of url without user, port and a final dot; an IPv6 address without its brackets; null if there is none."""
    raw = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9a-f:.]+\]|[^/?#:@\[\]]+)", 1)
    return F.nullif(F.regexp_replace(raw, r"^\[|\]$|\.$", ""), F.lit(""))


def domains_of(host) -> F.Column:
    """The host and the domains above it; an IP address is the only one of its own."""
    labels = F.split(host, r"\.")
    return F.when(host.rlike(r"^[0-9.]+$|:"), F.array(host)).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def intervals(entries: DataFrame) -> DataFrame:
    """domain, valid_from, valid_until (null: open) from entries(domain, date, action 'add' or 'remove').

    On one date an addition outweighs a removal. A second addition or removal in a row changes nothing.
    Rows with a null domain or date are left out, as are removals of what isn't listed.
    """
    day = entries.where("domain is not null and date is not null").groupBy("domain", "date").agg(F.max(F.col("action") == "add").alias("on"))
    w = Window.partitionBy("domain").orderBy("date")
    turn = day.withColumn("was", F.coalesce(F.lag("on").over(w), F.lit(False))).where("on <> was")
    spans = turn.withColumn("valid_until", F.lead("date").over(w)).where("on")
    return spans.select("domain", F.col("date").alias("valid_from"), "valid_until")


def temporal_list_join(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """id, host, fetched, blocked, matched_domain, listed_since for every capture.

    A capture is blocked if its host, or a domain above it, is listed at its fetch date (valid_from
    <= fetched < valid_until); the longest such domain is named. The verdict depends on host and date only, so
    captures are reduced to these first: a host that holds a third of all rows is one row a date. A pair has
    one row for each of its domains, so the as-of join is an equality on domain with a range on top, never a cross join.
    Null or malformed URLs and null dates match nothing and stay; rows that repeat an id, or have none, are each
    judged by their own URL; URLs of any length are read whole. Empty tables of captures give an empty one, of entries no match.
    """
    q = lambda c: F.col(f"`{c}`")
    c = captures.select(q(id_col).alias("id"), host_of(q(url_col)).alias("host"), q(time_col).alias("fetched"))
    keyed = c.where("host is not null and fetched is not null").select("host", "fetched").distinct().withColumn("domain", F.explode(domains_of(F.col("host"))))
    hits = keyed.join(intervals(entries), "domain").where("valid_from <= fetched and (valid_until is null or fetched < valid_until)")
    best = written(hits.groupBy("host", "fetched").agg(F.max(F.struct(F.length("domain").alias("n"), "domain", "valid_from")).alias("m")))
    return c.join(best, ["host", "fetched"], "left").select(F.col("id").alias(id_col), "host", F.col("fetched").alias("fetched"), F.col("m").isNotNull().alias("blocked"), F.col("m.domain").alias("matched_domain"), F.col("m.valid_from").alias("listed_since"))
