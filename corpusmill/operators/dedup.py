"""Exact duplicates: keep-first, reasons of removal, overlap counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import HUMAN_TYPES, normalize


def hashed(df: DataFrame, id_col: str, text_col: str, strict: bool = False) -> DataFrame:
    return df.select(id_col, F.sha1(normalize(F.col(text_col), strict)).alias("h"))


def keep_first(h: DataFrame, id_col: str) -> DataFrame:
    """The first row of each hash in input order; a minimum, which combines before the shuffle."""
    return h.groupBy("h").agg(F.min(id_col).alias(id_col))


def dup_groups(h: DataFrame) -> DataFrame:
    c = h.groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    return c.agg(F.count_if(F.col("c") > 1).alias("dup_groups"), F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c") - 1)), F.lit(0)).alias("dup_items"))


def exact_overlap(test: DataFrame, train: DataFrame) -> DataFrame:
    a, b = (x.groupBy("h").agg(F.count(F.lit(1)).alias(n)) for x, n in ((test, "ca"), (train, "cb")))
    return a.join(b, "h").agg(F.coalesce(F.sum(F.least("ca", "cb")), F.lit(0)).alias("overlap"), F.count(F.lit(1)).alias("common_keys"))


def overlap_examples(test: DataFrame, train: DataFrame, n: int = 20) -> DataFrame:
    """h: the n smallest hashes that stand on both sides. Each task keeps its n smallest before they meet."""
    return train.select("h").distinct().join(test.select("h").distinct(), "h", "left_semi").orderBy("h").limit(n)


def removal_reasons(test: DataFrame, train: DataFrame, near_ids: DataFrame, id_col: str) -> DataFrame:
    """id, reason for each training row: internal duplicate, then exact, then near; a hash counts as seen even if its first row goes.

    The first row of a hash is a minimum, which combines before the shuffle: no task orders the rows of a hash.
    """
    first = train.groupBy("h").agg(F.min(id_col).alias("first"))
    t = train.join(first, "h").join(test.select("h").distinct().withColumn("ex", F.lit(True)), "h", "left")
    t = t.join(near_ids.select(F.col(id_col)).distinct().withColumn("nr", F.lit(True)), id_col, "left")
    return t.select(id_col, F.when(F.col(id_col) > F.col("first"), "internal_dup").when(F.col("ex"), "exact").when(F.col("nr"), "near").otherwise("kept").alias("reason"))


def removal_counters(reasons: DataFrame) -> DataFrame:
    """before, internal_dup, exact, near, after from removal_reasons(), in one pass."""
    r = F.col("reason")
    return reasons.agg(F.count(F.lit(1)).alias("before"), *[F.count_if(r == k).alias(k) for k in ("internal_dup", "exact", "near")], F.count_if(r == "kept").alias("after"))


def leakage_by(test: DataFrame, train: DataFrame, by: str, id_col: str, text_col: str) -> DataFrame:
    """by, train_n, test_n, their internal duplicates, exact overlaps by light and strict forms and near pairs at 0.9 and 0.8: a row for each value of `by`, such as a data set, on either side.

    Each pair of sets is compared within its value alone. Counts by hash come first, so copies are one row each before any join.
    """
    from corpusmill.operators import neardup

    def counts(df, strict, name):
        h = df.where(F.col(by).isNotNull()).select(by, F.sha1(normalize(F.col(text_col), strict)).alias("h"))
        return h.groupBy(by, "h").agg(F.count(F.lit(1)).alias(name))

    out = None
    for strict in (False, True):
        c = counts(train, strict, "a").join(counts(test, strict, "b"), [by, "h"], "full")
        both = F.coalesce(F.sum(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.least("a", "b"))), F.lit(0))
        sizes = []
        if not strict:
            sizes = [F.coalesce(F.sum(x), F.lit(0)).alias(f"{n}_n") for x, n in (("a", "train"), ("b", "test"))]
            sizes += [F.coalesce(F.sum(F.col(x) - 1), F.lit(0)).alias(f"{n}_internal_dup_items_light") for x, n in (("a", "train"), ("b", "test"))]
        part = c.groupBy(by).agg(*sizes, both.alias(f"exact_overlap_{'strict' if strict else 'light'}"))
        out = part if out is None else out.join(part, by)
    near = neardup.near_summary(test, train, id_col, text_col, within=by, near_ge_90_pairs=0.9, near_ge_80_pairs=0.8)
    out = out.join(near.withColumnRenamed("candidates", "near_candidates_total"), by, "left")
    return out.na.fill(0, ["near_candidates_total", "near_ge_90_pairs", "near_ge_80_pairs"])


def removal_by(test: DataFrame, train: DataFrame, by: str, id_col: str, text_col: str, least: float = 0.95) -> DataFrame:
    """by, train_before, train_internal_dup_removed, train_test_exact_removed, train_test_near_removed, train_after: removal_reasons() counted for each value of `by` on the training side, within which alone texts are compared."""
    from corpusmill.operators import neardup

    form = lambda df: df.where(F.col(by).isNotNull()).select(by, F.col(id_col).alias("id"), F.sha1(normalize(F.col(text_col))).alias("h"))
    t = form(train)
    near = neardup.near_classes(test, train, id_col, text_col, within=by, least=least).select(by, F.col("train_h").alias("h")).distinct().withColumn("nr", F.lit(True))
    t = t.join(t.groupBy(by, "h").agg(F.min("id").alias("first")), [by, "h"]).join(form(test).select(by, "h").distinct().withColumn("ex", F.lit(True)), [by, "h"], "left").join(near, [by, "h"], "left")
    reason = F.when(F.col("id") > F.col("first"), "internal_dup").when(F.col("ex"), "exact").when(F.col("nr"), "near").otherwise("kept")
    t = t.select(by, reason.alias("reason"))
    r = F.col("reason")
    names = {"internal_dup": "train_internal_dup_removed", "exact": "train_test_exact_removed", "near": "train_test_near_removed"}
    return t.groupBy(by).agg(F.count(F.lit(1)).alias("train_before"), *[F.count_if(r == k).alias(n) for k, n in names.items()], F.count_if(r == "kept").alias("train_after"))


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, side ('left', 'right' or 'both') for the distinct keys of either."""
    a, b = left.select(key).distinct().withColumn("a", F.lit(1)), right.select(key).distinct().withColumn("b", F.lit(1))
    return a.join(b, key, "full").select(key, F.when(F.col("b").isNull(), "left").when(F.col("a").isNull(), "right").otherwise("both").alias("side"))


def nested_texts(df: DataFrame, id_col: str) -> DataFrame:
    """item, llm, attack, place, text, is_human from records of (data_type, text, label: model -> attack -> texts): one row for a human record, one for each text of another. Null texts go."""
    human = F.coalesce(F.col("data_type").isin(*HUMAN_TYPES), F.lit(False))
    none = F.lit(None).cast("string")
    own = df.where(human).select(F.col(id_col).alias("item"), none.alias("llm"), none.alias("attack"), F.lit(0).alias("place"), F.coalesce("text", F.lit("")).alias("text"), F.lit(True).alias("is_human"))
    by_model = df.where(~human).select(F.col(id_col).alias("item"), F.explode("label").alias("llm", "attacks"))
    by_attack = by_model.select("item", "llm", F.explode("attacks").alias("attack", "texts"))
    return own.unionByName(by_attack.select("item", "llm", "attack", F.posexplode("texts").alias("place", "text"), F.lit(False).alias("is_human")).where("text is not null"))


def nested_reasons(texts: DataFrame, test_hashes: DataFrame, near_texts: DataFrame | None = None) -> DataFrame:
    """texts with reason: a human record repeats within all of them, another text within its item, model and attack; then exact, then near to a test text (h of near_texts). First means lowest item, then place."""
    t = texts.withColumn("h", F.sha1(normalize(F.col("text"))))
    scope = lambda c: F.when(~F.col("is_human"), F.col(c))
    keys = {"__item": scope("item"), "__llm": scope("llm"), "__attack": scope("attack")}
    t = t.withColumns(keys).withColumn("__at", F.struct("item", "place"))
    # A minimum, joined on equal or null keys: it combines before the shuffle, and no task orders the copies of a text.
    by = ["is_human", *keys, "h"]
    first = t.groupBy(*[F.col(k).alias(f"__f{i}") for i, k in enumerate(by)]).agg(F.min("__at").alias("__first"))
    t = t.join(first, [F.col(k).eqNullSafe(F.col(f"__f{i}")) for i, k in enumerate(by)]).drop(*[f"__f{i}" for i in range(len(by))])
    t = t.join(test_hashes.select("h").distinct().withColumn("__exact", F.lit(True)), "h", "left")
    t = t.withColumn("__near", F.lit(None).cast("boolean")) if near_texts is None else t.join(near_texts.select("h").distinct().withColumn("__near", F.lit(True)), "h", "left")
    reason = F.when(F.col("__at") > F.col("__first"), "internal_dup").when(F.col("__exact"), "exact").when(F.col("__near"), "near").otherwise("kept")
    return t.withColumn("reason", reason).drop("__at", "__first", "__exact", "__near", *keys)


def nested_counters(records: DataFrame, reasons: DataFrame) -> DataFrame:
    """train_before, the removals of human and other texts by reason, and train_after: records, of which only human ones can go."""
    r, human = F.col("reason"), F.col("is_human")
    by = [F.count_if((human if who == "human" else ~human) & (r == why)).alias(f"{who}_{why}") for who in ("human", "gen") for why in ("internal_dup", "exact", "near")]
    lost = F.count_if(human & (r != "kept")).alias("lost")
    both = reasons.agg(*by, lost).join(F.broadcast(records.agg(F.count(F.lit(1)).alias("train_before"))))  # one row each
    return both.withColumn("train_after", F.col("train_before") - F.col("lost")).drop("lost")


def nested_filtered(records: DataFrame, reasons: DataFrame, id_col: str) -> DataFrame:
    """The records whose human text is kept, and others without the texts that go or are null; a model or attack left without texts stays, empty. Ids must be unique."""
    lost = reasons.where("reason <> 'kept'").select(F.col("item").alias(id_col), "is_human", "llm", "attack", "place")
    gone = lost.where("not is_human").groupBy(id_col).agg(F.collect_list(F.struct("llm", "attack", "place")).alias("__gone"))
    out = records.join(lost.where("is_human").select(id_col), id_col, "left_anti").join(gone, id_col, "left")
    goes = lambda llm, attack, i: F.coalesce(F.array_contains("__gone", F.struct(llm.alias("llm"), attack.alias("attack"), i.alias("place"))), F.lit(False))
    left = F.transform_values("label", lambda llm, attacks: F.transform_values(attacks, lambda attack, texts: F.filter(texts, lambda t, i: t.isNotNull() & ~goes(llm, attack, i))))
    human = F.coalesce(F.col("data_type").isin(*HUMAN_TYPES), F.lit(False))
    return out.withColumn("label", F.when(human, F.col("label")).otherwise(left)).select(records.columns)


def record_diff(base: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """key, verdict, field for records that differ: 'missing' in target (a failure), 'extra' in it (a warning), or 'differs' with the first column, by base's order, whose values differ. Nulls are equal."""
    fields = [c for c in base.columns if c != key]
    a, b = (x.select(key, F.lit(True).alias(f"__{n}"), *[F.col(f).alias(f"__{n}_{f}") for f in fields]) for n, x in (("a", base), ("b", target)))
    first = F.coalesce(*[F.when(~F.col(f"__a_{f}").eqNullSafe(F.col(f"__b_{f}")), f) for f in fields], F.lit(None).cast("string"))
    both = a.join(b, key, "full")
    verdict = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "extra").when(first.isNotNull(), "differs")
    return both.select(key, verdict.alias("verdict"), F.when(verdict == "differs", first).alias("field")).where("verdict is not null")


def paired_files(files: DataFrame) -> DataFrame:
    """dataset, seed, train, test, problem from (file, dataset, seed, split): each training file with its data set's test file; 'missing_test' or 'missing_train' where there is none."""
    train = files.where("split = 'train'").select("dataset", "seed", F.col("file").alias("train"))
    test = files.where("split = 'test'").groupBy("dataset").agg(F.max("file").alias("test"))
    return train.join(test, "dataset", "full").withColumn("problem", F.when(F.col("test").isNull(), "missing_test").when(F.col("train").isNull(), "missing_train"))
