"""N-gram Jaccard join: rare-first prefixes with length, positional and suffix filters, one check for each pair."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import erase, kept, shared_dir, written
from .components import components

_SPAN = 1 << 20
_LONG_WORD = 256
_SHORT = 256
_SHORTS = [f"w{i}" for i in range(_SHORT // 64)]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MIX, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return kept(("shingle tables",), _made_tables)


def _made_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A value for each byte, letters of both cases alike; powers of an odd base modulo 2**64; and their inverses."""
    byte = np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    byte[0x41:0x5B] = byte[0x61:0x7B]
    base = 0xD1342543DE82EF95
    powers = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(_SPAN, b, np.uint64)])) for b in (base, pow(base, -1, 1 << 64))]
    return byte, powers[0], powers[1]


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words data[start:end], A-Z lower-cased: differences of running polynomial sums; words over 256 bytes, which could be built to collide there, by xxh3."""
    byte, power, inverse = _tables()
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        first = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, first + _SPAN, "right")))
        if ends[j - 1] - first <= _SPAN:
            part = data[first : ends[j - 1]]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(byte[part] * power[: len(part)], out=sums[1:])
            s = starts[i:j] - first
            out[i:j] = (sums[ends[i:j] - first] - sums[s]) * inverse[s]
        i = j
    length = (ends - starts).astype(np.uint64)
    for w in np.flatnonzero(length > _LONG_WORD):
        out[w] = xxhash.xxh3_64_intdigest(data[starts[w] : ends[w]].tobytes().lower())
    return (out ^ (out >> np.uint64(32))) * _MIX + length


def _sets_of_block(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For texts data[at[i]:at[i + 1]]: their sorted distinct shingle hashes one after the other, and where each begins."""
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = ~solid[:-1], ~solid[1:]
    starts, ends = np.flatnonzero(solid & (before | edge[:-1])), np.flatnonzero(solid & (after | edge[1:])) + 1
    h = _word_hashes(data, starts, ends)
    first = np.searchsorted(starts, at)
    words = np.diff(first)

    def chain(index, n):
        out = np.zeros(len(index), np.uint64)
        for i in range(n):
            out = out * _STEP + h[index + i]
            out ^= out >> np.uint64(29)
        out = out * _MIX + np.uint64(n)
        return out ^ (out >> np.uint64(32))

    whole = np.ones(len(h), bool)
    for j in range(1, k):
        last = first[1:] - j
        whole[last[last >= first[:-1]]] = False
    begin = np.concatenate([[0], np.cumsum(np.maximum(words - k + 1, words > 0))])
    out = np.zeros(begin[-1], np.uint64)
    rest = np.ones(len(out), bool)
    for n in range(1, k):
        short = np.flatnonzero(words == n)
        out[begin[short]] = chain(first[short], n)
        rest[begin[short]] = False
    out[rest] = chain(np.flatnonzero(whole), k)
    for i in np.flatnonzero(words > k):
        out[begin[i] : begin[i + 1]].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[begin[:-1][begin[:-1] < len(out)]] = True
    return out[new], np.concatenate([[0], np.cumsum(new)])[begin]


def shingle_sets(texts: pa.Array, k: int = 4, block: int = 4 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, hashes, offsets) for runs of texts of about block bytes; a longer text is a run of its own.

    A text's hashes are sorted and distinct; one with fewer words is one shingle, one without words or null has none.
    """
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = min(len(texts), max(i + 1, int(np.searchsorted(at, at[i] + block, "right")) - 1))
        yield i, *_sets_of_block(data[at[i] : at[j]], at[i : j + 1] - at[i], k)
        i = j


def shingle_set(text: bytes | None, k: int = 4) -> np.ndarray:
    """The set of one text."""
    return next(shingle_sets(pa.array([text], pa.binary()), k))[1]


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * |x & y| >= percent * |x | y|, after the suffix filter on halves of the hash range."""
    if not len(x) or not len(y):
        return False
    total = len(x) + len(y)
    m = y[len(y) // 2]
    a, b = int(np.searchsorted(x, m)), len(y) // 2
    if (100 + percent) * (min(a, b) + min(len(x) - a, len(y) - b)) < percent * total:
        return False
    merged = np.concatenate([x, y])
    merged.sort()
    both = int((merged[1:] == merged[:-1]).sum())
    return 100 * both >= percent * (total - both)


def parity(s: np.ndarray) -> np.ndarray:
    """Bytes whose bit j is the parity of the shingles that equal j modulo their number, a power of two of at least twice the set's size and _SHORT."""
    bits = max(_SHORT, 1 << (2 * len(s) - 1).bit_length() if len(s) else 0)
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little")


def folded(x: np.ndarray, size: int) -> np.ndarray:
    """The parities of a set for a smaller number of bits, in size bytes."""
    return np.bitwise_xor.reduce(x.reshape(-1, size), axis=0)


def frequent(rows: DataFrame, k: int, bound: int = 65_536, least: int = 3, chunk: int = 4_000_000) -> np.ndarray:
    """At most bound shingles that stand in most texts, rarest first. Counts cover all texts and are summed over blocks; what a block holds under least times isn't sent."""

    def count(batches):
        held, n = [], 0

        def told():
            v = np.concatenate(held)
            v.sort()
            at = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
            c = np.diff(np.append(at, len(v)))
            v, c = v[at][c >= least], c[c >= least]
            return pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(c)], names=["s", "c"])

        for b in batches:
            for _, s, _ in shingle_sets(b.column(1), k):
                held.append(s)
                n += len(s)
                if n >= chunk:
                    yield told()
                    held, n = [], 0
        if held:
            yield told()

    top = rows.mapInArrow(count, "s long, c long").groupBy("s").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "s").limit(bound).collect()
    return np.array([r["s"] for r in reversed(top)], np.int64).view(np.uint64)


def prefixes(rows: DataFrame, order: np.ndarray, k: int, percent: int) -> DataFrame:
    """id, n and, for the n - ceil(percent * n / 100) + 1 rarest shingles, token, pos and hot (it is in order); with pos 0 or -1, bits (parity()) and w0 to w3, the same folded to _SHORT bits.

    Frequent shingles come last, in order of frequency, the others by hash.
    """
    by_value = np.argsort(order)
    values = order[by_value]

    def run(batches):
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            for i, s, at in shingle_sets(b.column(1), k):
                n = np.diff(at)
                bits = [parity(s[x:y]) for x, y in zip(at[:-1], at[1:])]
                if len(values):
                    near = np.minimum(np.searchsorted(values, s), len(values) - 1)
                    rank = np.where(values[near] == s, by_value[near] + 1, 0)
                    held = np.concatenate([[0], np.cumsum(rank > 0)])[at]
                    for t in np.flatnonzero(np.diff(held)):
                        part = slice(at[t], at[t + 1])
                        s[part] = s[part][np.argsort(rank[part], kind="stable")]
                p = np.where(n > 0, n - -(-percent * n // 100) + 1, 1)
                pos = np.arange(p.sum()) - np.repeat(np.cumsum(p) - p, p)
                none = np.repeat(n == 0, p)
                token = np.zeros(len(pos), np.uint64)
                token[~none] = s[(np.repeat(at[:-1], p) + pos)[~none]]
                pos[none] = -1
                hot = values[np.minimum(np.searchsorted(values, token), len(values) - 1)] == token if len(values) else np.zeros(len(pos), bool)
                # A null index gives a null: only a text's first row has its bits.
                first = pa.array(np.cumsum(pos <= 0) - 1, mask=pos > 0)
                short = np.stack([folded(x, _SHORT // 8) for x in bits]).view(np.int64)
                signs = [pa.array([x.tobytes() for x in bits], pa.binary()).take(first), *(pa.array(np.ascontiguousarray(c)).take(first) for c in short.T)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys[i : i + len(n)], p), pa.int64()), pa.array(np.repeat(n, p).astype(np.int32)), pa.array(token.view(np.int64)), pa.array(pos.astype(np.int32)), pa.array(hot), *signs], names=["id", "n", "token", "pos", "hot", "bits", *_SHORTS])

    return rows.mapInArrow(run, "id long, n int, token long, pos int, hot boolean, bits binary, " + ", ".join(f"{w} long" for w in _SHORTS))


def shingle_counts(rows: DataFrame, k: int) -> DataFrame:
    """h, n: the hash and set size of each row's text."""

    def run(batches):
        for b in batches:
            n = [c for _, _, at in shingle_sets(b.column(1), k) for c in np.diff(at).tolist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["h", "n"])

    return rows.select(F.xxhash64("text").alias("h"), "text").mapInArrow(run, "h long, n long")


def screened(pairs: DataFrame, size: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the parities of both sets don't rule out.

    Parities differ in no more bits than the sets differ in shingles, and sets that link differ in at
    most (100 - percent) / (100 + percent) of their summed sizes, so no link is lost.
    """
    x, y = (size.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}")) for c in "ab")

    def run(batches):
        for b in batches:
            total, u, v = (b.column(2).to_numpy() + b.column(4).to_numpy()).tolist(), b.column(3).to_pylist(), b.column(5).to_pylist()
            keep = []
            for t, p, q in zip(total, u, v):
                p, q = np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8)
                m = min(len(p), len(q))
                apart = int(np.bitwise_count(folded(p, m) ^ folded(q, m)).sum(dtype=np.int64))
                keep.append((100 + percent) * apart <= (100 - percent) * t)
            m = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(m), b.column(1).filter(m)], names=["a", "b"])

    return written(pairs.join(x, "a").join(y, "b").select("a", "b", "na", "bitsa", "nb", "bitsb").mapInArrow(run, "a long, b long"))


def verified(pairs: DataFrame, rows: DataFrame, k: int, percent: int, block: int = 256) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets, each checked once.

    The text of b travels once, to that of a; an a with many pairs is dealt out in blocks of them.
    """
    many = written(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("nb")))
    dealt = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("nb")).alias("s"))
    y = rows.join(dealt, rows["id"] == dealt["b"]).select("a", "s", "b", F.col("text").alias("y"))
    x = rows.join(many, rows["id"] == many["a"]).select("a", F.col("text").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("s"))

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                _, first, which = np.unique(part.column(0).to_numpy(), return_index=True, return_inverse=True)
                texts = (part.column(2).take(pa.array(first)), part.column(3))
                x, y = ([v[s:e] for _, v, at in shingle_sets(t, k) for s, e in zip(at[:-1], at[1:])] for t in texts)
                keep = pa.array([linked(x[w], q, percent) for w, q in zip(which, y)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], names=["a", "b"])

    return written(y.join(x, ["a", "s"]).select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """classes (id, c) after joining along links (a, b); a text without a row is a class of its own.

    Links become edges between classes, one for each pair of them, before components are sought.
    """
    e = links.join(classes.toDF("a", "ca"), "a", "left").join(classes.toDF("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    comp = components(e)
    old = classes.join(comp, classes["c"] == comp["node"], "left").select("id", F.coalesce("component", "c").alias("c"))
    new = comp.join(classes, comp["node"] == classes["id"], "left_anti").select("node", "component")
    return written(old.union(new))


def leaders(p: DataFrame) -> DataFrame:
    """Of p (token, id, n, pos, hot), tokens that several texts hold, with m, their number, and the shortest: lid, ln, lpos.

    One task must not meet all rows of a token that stands in a large share of the texts. Such tokens are hot,
    at most as many as frequent() returns: they are counted with a map-side combine and joined by broadcast.
    All others are dealt out by token once.
    """
    lead = (F.min(F.struct("n", "id", "pos")).alias("first"), F.count(F.lit(1)).alias("m"))
    named = lambda g: g.where("m > 1").select("token", "m", F.col("first.id").alias("lid"), F.col("first.n").alias("ln"), F.col("first.pos").alias("lpos"))
    hot, cold = p.where("hot").drop("hot"), p.where("not hot").drop("hot").repartition("token")
    return hot.join(F.broadcast(named(hot.groupBy("token").agg(*lead))), "token").unionByName(cold.join(named(cold.groupBy("token").agg(*lead)), "token"))


def ngram_jaccard_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85, bucket: int = 16) -> DataFrame:
    """id, n_shingles, component_id for every row of documents.

    Exact copies collapse first. A text then gives its rarest shingles: two texts that link share one
    there. For each shingle its shortest text is paired with the others, under the length and positional
    filters; checked pairs give classes, and only pairs of different classes follow. Shingles of many texts
    of several classes then deal them into buckets twice, of which each is compared within itself, so that
    similar texts flow together in linear work; last come all pairs of a shingle that still differ in class,
    mostly just where its texts first meet, so no link is lost. Parities of the sets rule out most pairs that
    don't link before any text is sent. A link becomes an edge between two classes, so a group of near copies
    costs few links, not their square. Null, empty and word-less texts have no shingles and stand alone; texts
    are read whole, of any length; ties break by id. A null id is no partner of any: it takes what a copy of its
    text with an id has, else the size of its own set and a null component. Rows that repeat an id repeat its
    result; if their texts differ, each text counts under that id. An empty table gives an empty one; columns
    other than id and text aren't read.
    """
    spark = documents.sparkSession
    every = documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hashes = (F.xxhash64("text").alias("h"), F.xxhash64(F.lit(5), "text").alias("g"))
    same = written(every.select("id", *hashes))
    copies = written(same.groupBy("h", "g").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m"))
    member = written(same.join(copies, ["h", "g"], "left").select("id", F.coalesce("rep", "id").alias("rep"), F.when(F.coalesce("rep", "id").isNull(), F.col("h")).alias("h")))
    d = every.where("id is not null")
    path = f"{shared_dir(spark)}/prefixes-{uuid.uuid4().hex}"
    # Texts aren't shuffled for this; the tokens of copies go afterwards.
    prefixes(d, frequent(d, k), k, percent).write.option("compression", "zstd").parquet(path)
    p = spark.read.parquet(path)
    size = written(p.where("pos <= 0").groupBy("id").agg(F.max("n").alias("n"), F.max("bits").alias("bits"), *(F.max(w).alias(w) for w in _SHORTS)))
    extra = member.where("id <> rep").select("id").distinct()
    q = p.where("pos >= 0 and token is not null and id is not null").join(extra, "id", "left_anti").select("token", "id", "n", "pos", "hot")
    shared = written(leaders(q))
    erase(spark, path)
    # Overlap needed by two sets, and what is left of both around the shared shingle, bound the pairs.
    fits = f"100 * least(n, ln) >= {percent} * greatest(n, ln) and (100 + {percent}) * (least(n - pos, ln - lpos) + least(pos, lpos)) >= {percent} * (n + ln)"
    met = written(shared.where("id <> lid").where(fits).groupBy("id", "lid").agg(F.count(F.lit(1)).alias("met")))
    # First each text with the leader it meets most, then with those of other classes.
    done = written(met.groupBy("id").agg(F.max(F.struct("met", "lid")).alias("m")).select(F.col("m.lid").alias("a"), F.col("id").alias("b")))
    classes = merged(written(met.select("id", F.col("lid").alias("c")).where("false")), verified(screened(done, size, percent), d, k, percent))
    x = met.select(F.col("lid").alias("a"), F.col("id").alias("b")).join(classes.toDF("a", "ca"), "a", "left").join(classes.toDF("b", "cb"), "b", "left")
    more = written(x.where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b").join(done, ["a", "b"], "left_anti"))
    classes = merged(classes, verified(screened(more, size, percent), d, k, percent))
    done = done.union(more)
    near = f"(100 + {percent}) * (" + " + ".join(f"bit_count({w} ^ l{w})" for w in _SHORTS) + f") <= (100 - {percent}) * (n + ln)"
    for step, of in enumerate((bucket, 4 * bucket, 0)):
        seen = shared.drop("lid", "ln", "lpos").join(classes, "id", "left").withColumn("c", F.coalesce("c", "id"))
        mixed = written(seen.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("token"))
        some = seen.join(mixed, "token", "left_semi").where(F.col("m") > (0, bucket, 4 * bucket)[step])
        # The shingles just before: where one of them is shared too, the pair has come up there.
        before = F.collect_list("token").over(Window.partitionBy("id").orderBy("pos").rowsBetween(-6, -1))
        parts = F.pow(F.lit(2), F.ceil(F.log2(F.col("m") / of))).cast("long") if of else F.lit(1)
        part = F.when(F.col("m") <= of, 0).otherwise(F.xxhash64(F.lit(step), "id").bitwiseAND(parts - 1)).cast("long")
        left = written(some.withColumn("before", before).withColumn("part", part).join(size.select("id", *_SHORTS), "id"))
        if left.isEmpty():
            break
        other = left.select("token", "part", *(F.col(c).alias(f"l{c}") for c in ("before", "id", "n", "pos", "c", *_SHORTS)))
        # A pair's shorter text comes first, as a shingle's leader does.
        rest = left.join(other, ["token", "part"]).where("c <> lc and (ln < n or ln = n and lid < id)").where(fits).where(near).where("not arrays_overlap(before, lbefore)").select(F.col("lid").alias("a"), F.col("id").alias("b")).distinct()
        rest = written(rest.join(done, ["a", "b"], "left_anti"))
        classes = merged(classes, verified(screened(rest, size, percent), d, k, percent))
        done = done.union(rest)
    lone = shingle_counts(every.where("id is null").select("id", "text"), k).groupBy("h").agg(F.max("n").alias("own"))
    joined = member.join(size.select(F.col("id").alias("rep"), "n"), "rep", "left").join(classes.toDF("rep", "c"), "rep", "left").join(lone, "h", "left")
    n = F.coalesce("n", "own")
    # Copies of one text are linked if it has words; a text without any stands alone.
    return joined.select(F.col("id").alias(id_col), n.cast("long").alias("n_shingles"), F.when(n == 0, F.col("id")).otherwise(F.coalesce("c", "rep")).alias("component_id"))
