"""Embedding near-duplicates by collision-counting projections."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components


def plan(n: int, cosine: float, dims: int, miss: float = 2e-4, cell: float = 1.2, count: int = 2) -> tuple[int, int, float, float]:
    """(cell projections of a table, tables, cell width, window) for n vectors: cells shrink with log n, and there are as many tables as let a pair at the bound collide in fewer than count of them with probability miss at most."""
    sd = math.sqrt(max(2 - 2 * cosine, 1e-6) / dims)
    width, window = cell / math.sqrt(dims), 2.5 * sd
    k = max(3, math.ceil(math.log(max(n, 2)) / 1.139) - 1)
    q = 0.9876 * (1 - min(0.9, sd * math.sqrt(2 / math.pi) / width)) ** k
    tables = count
    while sum(math.comb(tables, c) * q**c * (1 - q) ** (tables - c) for c in range(count)) > miss:
        tables += 1
    return k, tables, width, window


def _units(column: pa.Array, rows: np.ndarray) -> np.ndarray:
    """Unit vectors, in double precision, of rows that have equal lengths."""
    part = column.take(pa.array(rows))
    x = part.values.to_numpy(zero_copy_only=False).astype(np.float64)[part.offsets[0].as_py() : part.offsets[-1].as_py()].reshape(len(rows), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def embedding_neighbours(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", seed: int = 17, count: int = 2) -> DataFrame:
    """id, n_links, component_id, kept for every row; vectors with equal labels and cosine >= the bound link.

    Equal vectors of a label collapse first. In each of many tables a vector is sorted by one seeded projection,
    within the cell that several others give, and collides with those in a window centred on it. Collisions are
    counted for each pair over all tables; pairs with at least `count` of them are checked by cosine in double
    precision. The number of tables is calibrated so that a pair at the bound is missed with probability 2e-4
    at most. (Windows of single projections alone would let a fifth of all pairs collide, so they are narrowed by cells.)
    Large cells are dealt out in blocks. Each vector length has a plan of its own. Null, zero or non-finite vectors, vectors with
    such components, null labels and vectors of different lengths link with nothing; they are their own component.
    Rows that repeat an id each get a row; equal vectors under one or several ids are links of each other. A null id
    takes part like any other, but names no component. An empty table gives an empty one; columns of other names aren't read.
    """
    q = lambda c: F.col(f"`{c}`")
    v = vectors.select(q(id_col).alias("id"), q(vec_col).alias("v"), q(label_col).alias("l"))
    good = F.expr("l is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    hashes = (F.when(good, F.xxhash64("l", "v")).alias("h"), F.when(good, F.xxhash64(F.lit(3), "v", "l")).alias("g"))
    member = written(v.select("id", *hashes))
    classes = v.select("id", *hashes, "l", "v").where("h is not null").groupBy("h", "g").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"), F.first("l").alias("l"))
    classes = written(classes.withColumn("c", F.monotonically_increasing_id()))
    # Each length has tables of its own, by the most vectors of a label.
    shape = classes.groupBy("l", F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).groupBy("d").agg(F.max("n").alias("n")).collect()
    plans = {s["d"]: plan(s["n"], cosine, s["d"], count=count) for s in shape}

    def collisions(batches):
        made: dict = {}
        for b in batches:
            long = np.diff(b.column(2).offsets.to_numpy())
            for d in np.unique(long).tolist():
                k, tables, width, window = plans[d]
                if d not in made:
                    r = np.random.default_rng([seed, d])
                    made[d] = r.standard_normal((d, (k + 1) * tables)) / math.sqrt(d), r.uniform(0, width, k * tables)
                g, off = made[d]
                for some in np.array_split(np.flatnonzero(long == d), max(1, len(long) * tables * k // 4_000_000)):
                    p = _units(b.column(2), some) @ g
                    cells = np.floor((p[:, : k * tables] + off) / width).astype(np.int64).reshape(len(some), tables, k).view(np.uint64)
                    label = b.column(1).to_numpy(zero_copy_only=False)[some].astype(np.uint64)
                    h = (label * np.uint64(0x9E3779B97F4A7C15) + np.uint64(d))[:, None] * np.uint64(0xD1B54A32D192ED03) + np.arange(tables, dtype=np.uint64)
                    for j in range(k):
                        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, j]
                    s = p[:, k * tables :] / window
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy()[some], tables)), pa.array(h.view(np.int64).ravel()), pa.array(s.ravel())], names=["c", "cell", "s"])

    # s is the sorted projection in units of the window.
    keyed = written(classes.select("c", F.xxhash64("l").alias("l"), "v").mapInArrow(collisions, "c long, cell long, s double"))
    many = written(keyed.groupBy("cell").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("cell", F.ceil(F.col("m") / 512).cast("long").alias("nb")))
    full = keyed.join(many, "cell").withColumn("bin", F.floor("s"))
    left = full.select("cell", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"), F.col("c").alias("a"), F.col("s").alias("sa"), F.pmod(F.xxhash64("c"), F.col("nb")).alias("salt"))
    right = full.select("cell", "bin", F.col("c").alias("b"), "s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("salt"))
    met = left.join(right, ["cell", "bin", "salt"]).where("a < b and abs(s - sa) <= 1").groupBy("a", "b").agg(F.count(F.lit(1)).alias("met")).where(f"met >= {count}")

    def check(batches):
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            same = (np.diff(b.column(2).offsets.to_numpy()) == (long := np.diff(b.column(3).offsets.to_numpy()))) & b.column(4).to_numpy(zero_copy_only=False)
            for d in np.unique(long[same]):
                rows = np.flatnonzero(same & (long == d))
                keep[rows] = (_units(b.column(2), rows) * _units(b.column(3), rows)).sum(axis=1) >= cosine
            m = pa.array(keep)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(m), b.column(1).filter(m)], names=["a", "b"])

    one = classes.select("c", "v", "l")
    rows = met.join(one.toDF("a", "x", "la"), "a").join(one.toDF("b", "y", "lb"), "b")
    links = written(rows.select("a", "b", "x", "y", (F.col("la") == F.col("lb")).alias("same")).mapInArrow(check, "a long, b long"))
    degree = links.union(links.select("b", "a")).join(classes.select(F.col("c").alias("b"), "copies"), "b").groupBy(F.col("a").alias("c")).agg(F.sum("copies").alias("others"))
    comp = written(components(links).toDF("c", "component"))
    named = comp.join(classes.select("c", "rep"), "c").groupBy("component").agg(F.min("rep").alias("least"))
    told = classes.select("c", "h", "g", "rep", "copies").join(degree, "c", "left").join(comp, "c", "left").join(named, "component", "left")
    told = written(told.select("h", "g", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("least", "rep").alias("component_id")))
    out = member.join(told, ["h", "g"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))
