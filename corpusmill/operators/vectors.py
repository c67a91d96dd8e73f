"""Vectors pooled by attention, and mixed by the probabilities of options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: what the score of a masked row becomes, so that a group of masked rows alone is pooled evenly.
MASKED = -1e9


def attention_scores(vector: Column, weights: list[list[float]], bias: list[float], out: list[float], out_bias: float = 0.0) -> Column:
    """out . tanh(weights vector + bias) + out_bias of an array column."""
    dot = lambda w: F.aggregate(F.zip_with(vector, F.array(*map(F.lit, w)), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    return sum((F.lit(o) * F.tanh(dot(w) + F.lit(b)) for w, b, o in zip(weights, bias, out)), F.lit(out_bias))


def softmax_sums(rows: DataFrame, group: list[str], vector: str, score: str) -> DataFrame:
    """group and vector: the sum of the group's vectors, weighted by the softmax of its scores.

    The largest score of a group is taken off first, so that no exponential overflows. Sums are kept for each place of the vectors and combine before the
    shuffle, so a group that holds a third of all rows is as many rows of each task as vectors are long. Rows with a null vector or score are left out.
    """
    r = rows.where(F.col(vector).isNotNull() & F.col(score).isNotNull())
    top = r.groupBy(*group).agg(F.max(score).alias("__top"))
    same = None
    for g in group:
        e = F.col(g).eqNullSafe(F.col(f"__t_{g}"))
        same = e if same is None else same & e
    r = r.join(top.withColumnsRenamed({g: f"__t_{g}" for g in group}), same)
    weight = F.exp(F.col(score) - F.col("__top"))
    places = r.select(*group, weight.alias("__w"), F.posexplode(F.col(vector)).alias("__i", "__x"))
    sums = places.groupBy(*group, "__i").agg((F.sum(F.col("__w") * F.col("__x")) / F.sum("__w")).alias("__v"))
    return sums.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__v"))), lambda p: p["__v"]).alias(vector))


def attention_pool(rows: DataFrame, group: list[str], vector: str, score: str, mask: str | None = None) -> DataFrame:
    """group and the pooled vector: softmax_sums() in which masked rows (mask 0, false or null) score MASKED."""
    s = F.col(score) if mask is None else F.when(F.coalesce(F.col(mask).cast("boolean"), F.lit(False)), F.col(score)).when(F.col(score).isNotNull(), F.lit(MASKED))
    return softmax_sums(rows.select(*group, vector, s.alias("__score")), group, vector, "__score")


def gumbel(key: Column) -> Column:
    """Gumbel noise that depends on a string key alone: -log(-log(u)), u from the first 32 bits of its MD5."""
    u = (F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    return -F.log(-F.log(u))


def option_mix(options: DataFrame, group: list[str], key: str, vector: str, logit: str, tau: float = 1.0, seed: int | None = None) -> DataFrame:
    """group and the mixed vector of its options: weights are the softmax of (logit + noise) / tau, the noise keyed by seed and key; without a seed there is none."""
    noise = F.lit(0.0) if seed is None else gumbel(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return softmax_sums(options.select(*group, vector, ((F.col(logit) + noise) / tau).alias("__score")), group, vector, "__score")


def blended(hard: Column, soft: list[Column], share: float = 0.5) -> Column:
    """(1 - share) hard + share times the mean of the soft vectors; hard alone without any."""
    if not soft:
        return hard
    total = soft[0]
    for s in soft[1:]:
        total = F.zip_with(total, s, lambda x, y: x + y)
    return F.zip_with(hard, total, lambda h, s: (1 - share) * h + share * s / len(soft))


def first_best(values: Column) -> Column:
    """The place, from 0, of the largest of an array, the first of equal ones; null without values."""
    return F.nullif(F.array_position(values, F.array_max(values)), F.lit(0).cast("long")) - 1
