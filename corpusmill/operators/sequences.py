"""Order-dependent operators: islands, chunks, hash-ranked samples, splits and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, group: str, order: str, signature: str) -> DataFrame:
    """Adds island: runs of equal signature within group."""
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn("change", F.coalesce((~F.col(signature).eqNullSafe(F.lag(signature).over(w))).cast("int"), F.lit(1))).withColumn("island", F.sum("change").over(w)).drop("change")


def monotone_chunks(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Adds chunk: a new one starts when value falls."""
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn("chunk", F.sum(F.when(F.col(value) < F.lag(value).over(w), 1).otherwise(0)).over(w))


def ranked(df: DataFrame, part: str, id_col: str, seed: str) -> DataFrame:
    """Adds rk, the rank in part by a seeded hash, and cnt, the size of part.

    A part is counted in 4,096 slices of the hash first, so that no task orders all rows of a class.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")))
    d = df.withColumn("__key", key).withColumn("__slice", F.substring("__key", 1, 3))
    counts = d.groupBy(F.col(part).alias("__p"), F.col("__slice").alias("__s")).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy("__p")
    base = counts.withColumn("__base", F.sum("__n").over(w.orderBy("__s")) - F.col("__n")).withColumn("cnt", F.sum("__n").over(w))
    d = d.join(base, F.col(part).eqNullSafe(F.col("__p")) & (F.col("__slice") == F.col("__s")))
    rk = F.col("__base") + F.row_number().over(Window.partitionBy(part, "__slice").orderBy("__key", id_col))
    return d.withColumn("rk", rk).select(*df.columns, "rk", "cnt")


def stratified_split(df: DataFrame, label: str, id_col: str, ratio: float, seed: str) -> DataFrame:
    return ranked(df, label, id_col, seed).select(id_col, label, F.when(F.col("rk") <= F.bround(F.col("cnt") * F.lit(ratio)), "a").otherwise("b").alias("split"))


def balanced_batches(df: DataFrame, label: str, id_col: str, half: int, seed: str) -> DataFrame:
    """Half a batch from each class, cut to the smaller class; with one class alone, whole batches of all its rows."""
    r = ranked(df, label, id_col, seed)
    least = df.groupBy(label).agg(F.count(F.lit(1)).alias("c")).agg(F.min("c").alias("least"), F.count(F.lit(1)).alias("classes"))
    size = F.when(F.col("classes") == 1, 2 * half).otherwise(half)
    return r.join(F.broadcast(least)).where("rk <= least").select(id_col, label, F.floor((F.col("rk") - 1) / size).alias("batch"))


def pool(df: DataFrame, label: str, id_col: str, total: int, seed: str) -> DataFrame:
    """At most total / 2 rows of each class, by a seeded hash."""
    return ranked(df, label, id_col, seed).where(F.col("rk") <= total // 2).select(df.columns)


def segment_sample(df: DataFrame, group: str, order: str, signature: str, label: str, id_col: str, per_segment: int, seed: str) -> DataFrame:
    """id, label: at most per_segment rows of each run of equal signature within group, then as many of each class as the smaller has."""
    runs = islands(df, group, order, signature).withColumn("__run", F.concat_ws("/", F.col(group).cast("string"), F.col("island").cast("string"), F.col(signature)))
    some = ranked(runs, "__run", id_col, seed).where(F.col("rk") <= per_segment).select(id_col, label)
    r = ranked(some, label, id_col, seed)
    least = some.groupBy(label).agg(F.count(F.lit(1)).alias("c")).agg(F.min("c").alias("least"))
    return r.join(F.broadcast(least)).where("rk <= least").select(id_col, label)


def deck(chunks: DataFrame, group: str, chunk: str, strategies: list[str]) -> DataFrame:
    """Adds bucket and strategy: of each group's chunks, numbered from 0, every len(strategies) in a row form a bucket and take the strategies by turns; those beyond the last whole bucket go."""
    k = len(strategies)
    whole = chunks.groupBy(F.col(group).alias("__g")).agg(F.floor((F.max(chunk) + 1) / k).alias("__whole"))
    bucket = F.floor(F.col(chunk) / k)
    out = chunks.join(whole, F.col(group).eqNullSafe(F.col("__g"))).where(bucket < F.col("__whole"))
    return out.withColumn("bucket", bucket).withColumn("strategy", F.element_at(F.array(*map(F.lit, strategies)), (F.col(chunk) % k + 1).cast("int"))).drop("__g", "__whole")


# The ten strategies that a bucket's chunks are dealt, in the two versions of the deck.
DECK_1 = ("tau_0.2", "tau_0.2", "tau_0.5", "tau_0.5", "tau_0.8", "tau_0.8", "random", "random", "random", "random")
DECK_2 = ("tau_0.2", "tau_0.2", "tau_0.5", "tau_0.5", "tau_0.8", "tau_0.8", "random", "random", "aggressive", "aggressive")


def dealt(chunks: DataFrame, group: str, chunk: str, strategies: tuple = DECK_1, seed: str = "42", strict: bool = True) -> DataFrame:
    """Adds bucket and strategy as deck() does, but each bucket's strategies are shuffled, by a hash of seed, group, bucket and place.

    With strict, a group with fewer chunks than a bucket takes raises an error, which asks for one small aggregate at once.
    """
    k = len(strategies)
    if strict and not chunks.groupBy(group).agg(F.max(chunk).alias("m")).where(F.col("m") + 1 < k).isEmpty():
        raise ValueError(f"a group has fewer than {k} chunks")
    d = deck(chunks, group, chunk, list(strategies)).drop("strategy")
    order = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.struct(F.md5(F.concat_ws(":", F.lit(seed), F.col(group).cast("string"), F.col("bucket").cast("string"), j.cast("string"))).alias("h"), j.alias("j")))
    places = F.transform(F.array_sort(order), lambda x: x["j"])
    return d.withColumn("strategy", F.get(F.array(*map(F.lit, strategies)), F.array_position(places, (F.col(chunk) % k).cast("int")).cast("int") - 1))


def random_split(df: DataFrame, id_col: str, ratio: float = 0.8, seed: str = "42") -> DataFrame:
    """id, split: 'a' for exactly `ratio` of all rows (rounded half to even), chosen by a seeded hash, 'b' for the others."""
    return ranked(df.select(id_col, F.lit(0).alias("__all")), "__all", id_col, seed).select(id_col, F.when(F.col("rk") <= F.bround(F.col("cnt") * F.lit(ratio)), "a").otherwise("b").alias("split"))


def early_stopping(scores: DataFrame, order: str, value: str, patience: int, mode: str = "max") -> DataFrame:
    """Adds best (the running best), better (this row improves it) and stop (patience rows in a row didn't). One run's epochs, so one ordered window is enough."""
    w = Window.orderBy(order)
    best = (F.max if mode == "max" else F.min)(value)
    before = best.over(w.rowsBetween(Window.unboundedPreceding, -1))
    better = F.coalesce(F.col(value) > before if mode == "max" else F.col(value) < before, F.lit(True))
    d = scores.withColumn("best", best.over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("better", better)
    d = d.withColumn("__run", F.sum(F.col("better").cast("int")).over(w))
    bad = F.row_number().over(Window.partitionBy("__run").orderBy(order)) - 1
    return d.withColumn("stop", bad >= patience).drop("__run")


def early_stopping_runs(scores: DataFrame, run: str, order: str, value: str, patience: int, mode: str = "max", min_delta: float = 0.0) -> DataFrame:
    """run, order, best, better, stop for each epoch of each run: better if value passes the best so far by more than min_delta; stop once `patience` in a row didn't.

    The best moves only where a value is better, so no window gives it: rows stream through each task in order and one state, that of the run at hand,
    is kept. Rows without a value are left out.
    """
    import pyarrow as pa

    up = mode == "max"

    def folded(batches):
        now, first, best, bad = None, True, 0.0, 0
        for b in batches:
            out = []
            for r, v in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if first or r != now:
                    now, first, best, bad, better = r, False, v, 0, True
                else:
                    better = v > best + min_delta if up else v < best - min_delta
                    best, bad = (v, 0) if better else (best, bad + 1)
                out.append((best, better, not better and bad >= patience))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([x[i] for x in out], t) for i, t in enumerate((pa.float64(), pa.bool_(), pa.bool_())))], names=[run, order, "best", "better", "stop"])

    d = scores.where(F.col(value).isNotNull()).select(run, order, F.col(value).cast("double").alias(value))
    kind = lambda c: f"`{c}` {d.schema[c].dataType.simpleString()}"
    return d.repartition(run).sortWithinPartitions(run, order).mapInArrow(folded, f"{kind(run)}, {kind(order)}, best double, better boolean, stop boolean")


def seeded_sets(df: DataFrame, label: str, id_col: str, total: int = 6_000, ratio: float = 0.4, test_seed: str = "202401", seeds: tuple = ("11", "22", "33")) -> DataFrame:
    """split, seed, position (from 1), id: a pool of at most total / 2 rows of each class, `ratio` of each class of it as the one test set, and the rest as a training set
    in another order for each seed. Orders are by keyed hash; no task orders a whole set."""
    picked = pool(df.select(id_col, label), label, id_col, total, test_seed)
    split = stratified_split(picked, label, id_col, ratio, test_seed)
    each = split.withColumn("seed", F.explode(F.when(F.col("split") == "a", F.array(F.lit(test_seed))).otherwise(F.array(*map(F.lit, seeds)))))
    each = each.withColumn("set", F.concat_ws("/", "split", "seed"))
    r = ranked(each.select("set", "split", "seed", id_col), "set", id_col, F.col("seed"))
    return r.select(F.when(F.col("split") == "a", "test").otherwise("train").alias("split"), "seed", F.col("rk").alias("position"), id_col)


def write_in_order(df: DataFrame, path: str, *keys: str, files: int | None = None) -> None:
    """df as JSON lines in the order of keys: read by name, one after the other, its files (as many as asked for, or as Spark likes) hold the rows in that order. Ranges of keys are dealt to tasks; none sorts all rows."""
    df.repartitionByRange(*([files] if files else []), *keys).sortWithinPartitions(*keys).write.json(path)
