"""Mixing sources to target weights: exact block quotas, split over shards by a hypergeometric tree."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_unit, n_words, written


def targets(sizes: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """source, rank, source_size, target for sizes(source, source_size): weights repeat by code point order, null last.

    Targets share `share` of all words by weight; one above ceiling times its source stops there and the
    excess goes to the others by weight. That is a level c with target = min(c * weight, ceiling * size),
    found from running sums in order of size / weight.
    """
    w = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("rank", F.row_number().over(w)).withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1))
    r = ranked.withColumn("cap", F.lit(ceiling) * F.col("source_size")).withColumn("at", F.col("cap") / F.col("w"))
    run = Window.orderBy("at", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()
    r = r.withColumn("capped", F.sum("cap").over(run)).withColumn("used", F.sum("w").over(run)).withColumn("all_w", F.sum("w").over(every)).withColumn("budget", F.lit(share) * F.sum("source_size").over(every))
    # A source is capped while the level its predecessors leave reaches its own.
    r = r.withColumn("level", (F.col("budget") - (F.col("capped") - F.col("cap"))) / (F.col("all_w") - F.col("used") + F.col("w")))
    free = F.min(F.when(F.col("level") < F.col("at"), F.struct("at", "rank", "level"))).over(every)
    r = r.withColumn("c", free["level"])
    return r.select("source", "rank", "source_size", F.coalesce(F.least(F.col("c") * F.col("w"), F.col("cap")), F.col("cap")).cast("double").alias("target"))


def running(t: DataFrame, part: list[str], key: str, value: str, tie: list[str], slices: int = 1024) -> DataFrame:
    """t with upto, the sum of value over the rows of part up to this one by key (in [0, 1)) and tie.

    Slices of the key are summed first, so that no task has to order all rows of a part.
    """
    t = t.withColumn("slice", F.floor(F.col(key) * slices))
    w = Window.partitionBy(*part).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    base = t.groupBy(*part, "slice").agg(F.sum(value).alias("v")).withColumn("base", F.coalesce(F.sum("v").over(w), F.lit(0))).drop("v")
    own = Window.partitionBy(*part, "slice").orderBy(key, *tie).rowsBetween(Window.unboundedPreceding, 0)
    return t.join(base, [*part, "slice"]).withColumn("upto", F.col("base") + F.sum(value).over(own)).drop("base", "slice")


def tree(quotas: DataFrame, seed: int, levels: int) -> DataFrame:
    """rank, o, shard: the shard of each block due, o from 0 to quota - 1, from quotas(rank, quota).

    Every block due is a ticket. Each level sends half of a node's tickets, drawn without replacement by a keyed hash, to
    the left, which splits the node's quotas by the multivariate hypergeometric law.
    """
    many = quotas.where("quota > 0").select("rank", "quota", F.explode(F.expr("sequence(0L, (quota - 1) div 4096L)")).alias("run")).repartition("rank", "run")
    t = many.select("rank", F.explode(F.expr("sequence(run * 4096L, least(quota, (run + 1) * 4096L) - 1)")).alias("o"), F.lit(0).alias("shard"), F.lit(1).alias("one"))
    for level in range(levels):
        t = running(t.withColumn("k", hash_unit(F.lit(seed + 10 + level), "rank", "o")), ["shard"], "k", "one", ["rank", "o"])
        half = t.groupBy("shard").agg(F.floor(F.count(F.lit(1)) / 2).alias("half"))
        t = written(t.join(half, "shard").select("rank", "o", (F.col("shard") * 2 + (F.col("upto") > F.col("half")).cast("int")).alias("shard"), "one"))
    return t.drop("one")


def _name(c: str) -> str:
    return f"`{c}`"


def _key(id_col: str, text_col: str) -> tuple:
    return F.col(_name(id_col)).alias("id"), F.xxhash64(F.coalesce(F.col(_name(text_col)), F.lit(""))).alias("h")


def _block(seed: int) -> F.Column:
    return F.floor(hash_unit(F.lit(seed), "id", "h") * F.col("nb"))


def planned(documents: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple, share: float, ceiling: float, seed: int, shard_blocks: int, block_docs: int, rounds: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(units, sources, blocks, filled): what mix() and mixed() draw.

    units: id, h (hash of the text), source, size, n, for n equal rows; sources: source, rank, source_size, target, nb, passes; blocks: rank,
    block, open, shards (one for each time that all its rows are taken); filled: rank, block, id, h, size, n, more (how many of
    the n rows the last pass takes), last (their shard), for the units of open blocks.
    """
    units = written(documents.select(*_key(id_col, text_col), F.col(_name(source_col)).alias("source"), n_words(F.col(_name(text_col))).alias("size")).groupBy("id", "h", "source", "size").agg(F.count(F.lit(1)).alias("n")))
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    t = targets(sizes, weights, share, ceiling).join(sizes.select(F.col("source").alias("s2"), "docs"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    t = t.withColumn("nb", F.ceil(F.col("docs") / block_docs)).withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    t = written(t.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")))
    placed = units.join(t.select(F.col("source").alias("s2"), "rank", "nb"), F.col("source").eqNullSafe(F.col("s2"))).withColumn("block", _block(seed))
    b = written(placed.groupBy("rank", "block").agg(F.sum(F.col("size") * F.col("n")).alias("words")).withColumn("at", hash_unit(F.lit(seed + 2), "rank", "block")).withColumn("turn", F.lit(None).cast("int")))
    room = t.select("rank", F.col("rest").alias("room"))
    # Blocks in permuted order, until one doesn't fit: that one stays open, and the next turn goes on behind it.
    for turn in range(rounds):
        r = running(b.where("turn is null"), ["rank"], "at", "words", ["block"]).join(room, "rank")
        r = r.withColumn("new", F.when(F.col("upto") <= F.col("room"), turn).when(F.col("upto") - F.col("words") <= F.col("room"), -1))
        # Two blocks may start within the room if the first has no words.
        r = written(r.select("rank", "block", "words", "at", F.col("new").alias("turn")).unionByName(b.where("turn is not null")))
        room = t.select("rank", "rest").join(r.where("turn >= 0").groupBy("rank").agg(F.sum("words").alias("used")), "rank", "left").select("rank", (F.col("rest") - F.coalesce("used", F.lit(0))).alias("room"))
        b = r
    fits = placed.join(b.where("turn = -1").select("rank", "block"), ["rank", "block"]).withColumn("u", hash_unit(F.lit(seed + 1), "id", "h"))
    # At most `rounds` blocks of a source, so the lists are short.
    lists = fits.groupBy("rank").agg(F.sort_array(F.collect_list(F.struct("u", "h", "id", "block", "size", "n"))).alias("rows")).join(room, "rank")
    start = F.struct(F.col("room").cast("double").alias("room"), F.array().cast("array<bigint>").alias("more"))
    fill = F.aggregate("rows", start, lambda s, x: _fill(s, x))["more"]
    # Zipped, the fold is made once for a list.
    filled = written(lists.select("rank", F.explode(F.arrays_zip("rows", fill.alias("more"))).alias("x")).select("rank", "x.rows.block", "x.rows.id", "x.rows.h", "x.rows.size", "x.rows.n", "x.more"))
    whole = b.where("turn >= 0").groupBy("rank").agg(F.count(F.lit(1)).alias("whole"))
    part = filled.groupBy("rank").agg(F.max((F.col("more") > 0).cast("int")).alias("part"))
    have = b.groupBy("rank").agg(F.count(F.lit(1)).alias("have"))
    q = t.select("rank", "passes").join(have, "rank").join(whole, "rank", "left").join(part, "rank", "left").na.fill(0).withColumn("quota", F.col("passes") * F.col("have") + F.col("whole") + F.col("part"))
    q = written(q)
    levels = max(0, math.ceil(math.log2(max(1, (q.agg(F.sum("quota")).first()[0] or 0) / shard_blocks))))
    # The o-th block due, in permuted order and pass by pass, takes the source's o-th ticket.
    tickets = tree(q, seed, levels)
    b = running(b.withColumn("one", F.lit(1)).withColumn("taken", (F.col("turn") >= 0).cast("int")), ["rank"], "at", "one", ["block"]).withColumnRenamed("upto", "x")
    b = running(b.na.fill(0, ["taken"]), ["rank"], "at", "taken", ["block"]).join(q, "rank")
    each = F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1), lambda p: p * F.col("have") + F.col("x") - 1)).otherwise(F.array().cast("array<bigint>"))
    last = F.when(F.col("taken") == 1, F.array(F.col("passes") * F.col("have") + F.col("upto") - 1)).otherwise(F.array().cast("array<bigint>"))
    due = b.select("rank", "block", F.coalesce(F.col("turn") == -1, F.lit(False)).alias("open"), F.explode_outer(F.concat(each, last)).alias("o"))
    # A block has a ticket for each pass and one more at most.
    got = F.sort_array(F.collect_list(F.when(F.col("shard").isNotNull(), F.struct("o", "shard"))))
    blocks = written(due.join(tickets, ["rank", "o"], "left").groupBy("rank", "block").agg(F.first("open").alias("open"), F.transform(got, lambda x: x["shard"]).alias("shards")))
    filled = filled.join(q.where("part = 1").select("rank", (F.col("quota") - 1).alias("o")).join(tickets, ["rank", "o"]).select("rank", F.col("shard").alias("last")), "rank", "left")
    return units, t, blocks, filled


def _fill(s, x) -> F.Column:
    """One step of filling the room: as many of a unit's equal rows as fit."""
    k = F.when(x["size"] > 0, F.least(x["n"], F.floor(s["room"] / x["size"]))).otherwise(F.lit(0).cast("bigint"))
    return F.struct((s["room"] - k * x["size"]).alias("room"), F.concat(s["more"], F.array(k)).alias("more"))


def mix(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0, seed: int = 7, shard_blocks: int = 16, block_docs: int = 256, rounds: int = 3) -> DataFrame:
    """id, size, source_size, target, taken and shards (one for each time taken) for every row of documents.

    Native DataFrame functions only. A source's rows fall in blocks of about block_docs by a hash of id and text,
    and blocks are put in a permuted order. Whole passes take every block; of the last pass blocks are taken in order while
    they fit the target. One that doesn't is left open, and the order goes on behind it, `rounds` times; rows of the open blocks
    then fill what room is left. So taken is 0 to 2 times size, and a source misses its target by less than the shortest
    text that is left in its open blocks. The blocks due are the source's quota. A tree splits all quotas among shards of about shard_blocks
    blocks by the multivariate hypergeometric law, and each shard draws as many of the source's permuted blocks, disjoint from the others'.
    Only ids, hashes, sizes and sources move. Equal rows (id, text, source) are interchangeable and are taken by number, however many there are.
    Null ids are values like others; null texts and texts without words, of any length, have size 0 and are not taken; a null source is
    a source. An empty table gives an empty one; other columns aren't read.
    """
    units, t, blocks, filled = planned(documents, id_col, text_col, source_col, weights, share, ceiling, seed, shard_blocks, block_docs, rounds)
    placed = units.join(t.select(F.col("source").alias("s2"), "rank", "nb", "source_size", "target"), F.col("source").eqNullSafe(F.col("s2"))).withColumn("block", _block(seed)).join(blocks, ["rank", "block"])
    more = filled.select("rank", "block", F.col("id").alias("i2"), "h", F.col("size").alias("z2"), "more", "last")
    rows = placed.join(more, (placed["rank"] == more["rank"]) & (placed["block"] == more["block"]) & (placed["h"] == more["h"]) & placed["id"].eqNullSafe(more["i2"]) & (placed["size"] == more["z2"]), "left")
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    none = F.array().cast("array<int>")
    got = F.when(F.col("size") == 0, none).otherwise(F.concat("shards", F.when(F.col("k") <= F.col("more"), F.array("last")).otherwise(none)))
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.size(got)).cast("long").alias("taken"), got.alias("shards"), F.col("source").alias(source_col))


def mixed(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0, seed: int = 7, shard_blocks: int = 16, block_docs: int = 256, rounds: int = 3) -> DataFrame:
    """The mix itself: documents' columns, a row for each time mix() takes a row, by shard and shuffled within it.

    A row finds its shards by its block, so texts move once, to their shard. Of equal rows of which the last pass takes some,
    any may be those. Cases are as in mix().
    """
    _, t, blocks, filled = planned(documents, id_col, text_col, source_col, weights, share, ceiling, seed, shard_blocks, block_docs, rounds)
    names = [F.col(_name(c)) for c in documents.columns]
    d = documents.select(F.struct(*names).alias("row"), *_key(id_col, text_col), F.col(_name(source_col)).alias("source"))
    t = t.select(F.col("source").alias("s2"), "rank", "nb")
    d = d.join(t, F.col("source").eqNullSafe(F.col("s2"))).withColumn("block", _block(seed)).join(blocks, ["rank", "block"]).drop("source", "s2", "nb")
    more = written(filled.where("size = 0 or more > 0").select("rank", "block", F.col("id").alias("i2"), F.col("h").alias("h2"), "size", "n", "more", "last"))

    def filling(rows, of, kind):
        return rows.join(of.withColumnsRenamed({"rank": "r2", "block": "b2"}), (F.col("rank") == F.col("r2")) & (F.col("block") == F.col("b2")) & (F.col("h") == F.col("h2")) & F.col("id").eqNullSafe(F.col("i2")), kind)

    none = F.array().cast("array<int>")
    out = filling(d, more.where("more = n"), "left").select("row", "id", "h", F.concat("shards", F.when(F.col("more") > 0, F.array("last")).otherwise(none)).alias("shards"))
    some = more.where("more > 0 and more < n")
    if not some.isEmpty():
        w = Window.partitionBy("rank", "block", "h", "id").orderBy("h")
        extra = filling(d, some, "inner").withColumn("k", F.row_number().over(w)).where("k <= more").select("row", "id", "h", F.array("last").alias("shards"))
        out = out.unionByName(extra)
    out = out.where(n_words(F.col("row")[text_col]) > 0).select("row", F.posexplode("shards").alias("k", "shard"), "id", "h")
    return out.repartition("shard").sortWithinPartitions("shard", F.xxhash64(F.lit(seed + 3), "id", "h", "k"), "k").select("row.*")
