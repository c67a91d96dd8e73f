"""Connected components of an edge table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _settled(batches):
    """node, up: the smallest node reachable by edges a, b, by union-find over all batches."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (r := root.setdefault(x, x)) != x:
            root[x] = x = root.setdefault(r, r)
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(root, pa.int64()), pa.array([find(x) for x in root], pa.int64())], names=["node", "up"])


def components(edges: DataFrame, a: str = "a", b: str = "b", few: int = 16_384, max_rounds: int = 200) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that stands in an edge.

    While there are more than `few` edges, every node goes over to the first, by a hash that changes with
    the round, of itself and its neighbours; edges are renamed, and loops and repeats vanish. So the edges shrink with
    every round: a star or clique is one round, and a chain loses about a third of its nodes in each. The few that
    are left are settled by union-find in one task. Minima and distinct edges combine before the shuffle;
    joins read written tables, so that Spark can split a node of many edges. Null ends, loops and repeated edges change
    nothing; an empty table gives an empty one. Raises if over `few` edges are left after max_rounds.
    """
    ends = lambda x, y: (F.least(x, y).cast("long").alias("a"), F.greatest(x, y).cast("long").alias("b"))
    e = written(edges.where(f"{a} is not null and {b} is not null and {a} <> {b}").select(*ends(F.col(a), F.col(b))).distinct())
    maps: list[DataFrame] = []
    while e.count() > few:
        if len(maps) == max_rounds:
            raise RuntimeError(f"edges are left after {max_rounds} rounds")
        first = lambda c: F.struct(F.xxhash64(F.lit(len(maps)), c).alias("h"), F.col(c).alias("to"))
        near = e.union(e.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.min(first("b")).alias("m"))
        up = written(near.select("node", F.least("m", first("node"))["to"].alias("up")))
        maps.append(up)
        e = written(e.join(up.toDF("a", "ua"), "a").join(up.toDF("b", "ub"), "b").where("ua <> ub").select(*ends("ua", "ub")).distinct())
    root = written(e.coalesce(1).mapInArrow(_settled, "node long, up long"))
    if not maps:
        return root.toDF("node", "component")
    while maps:
        up, above = maps.pop(), root.toDF("up", "top")
        root = written(up.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up")))
    least = written(root.groupBy("up").agg(F.min("node").alias("component")))
    return root.join(least, "up").select("node", "component")
