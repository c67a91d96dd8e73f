"""Evaluation of a binary detector from (label, prob)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import LEFT_OUT, scaled_delta, scaled_metric


def confusion(df: DataFrame, threshold: float = 0.5, inclusive: bool = True) -> DataFrame:
    p = (F.col("prob") >= threshold) if inclusive else (F.col("prob") > threshold)
    y = F.col("label") == 1
    return df.agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))


def _running(g: DataFrame, key: str, *counts: str, down: bool = False) -> DataFrame:
    """g, of distinct keys, with before_<c> for each count: its sum over the keys below (or above) this one.

    Keys fall in at most 4,100 slices by size, whose sums come first; then each slice is ordered for itself. So no task orders all keys.
    """
    x = F.col(key).cast("double")
    place = F.when(x.isNull(), -2).when(F.isnan(x), 4098).otherwise(F.least(F.lit(4097), F.greatest(F.lit(-1), F.floor(x * 4096)))).cast("int")
    g = g.withColumn("__slice", place)
    by = lambda c: F.desc(c) if down else F.asc(c)
    earlier = Window.orderBy(by("__slice")).rowsBetween(Window.unboundedPreceding, -1)
    slices = g.groupBy("__slice").agg(*[F.sum(c).alias(f"__{c}") for c in counts])
    slices = slices.select("__slice", *[F.coalesce(F.sum(f"__{c}").over(earlier), F.lit(0)).alias(f"__{c}") for c in counts])
    own = Window.partitionBy("__slice").orderBy(by(key)).rowsBetween(Window.unboundedPreceding, -1)
    out = g.join(slices, "__slice").withColumns({f"before_{c}": F.col(f"__{c}") + F.coalesce(F.sum(c).over(own), F.lit(0)) for c in counts})
    return out.drop("__slice", *[f"__{c}" for c in counts])


def _by_score(df: DataFrame) -> DataFrame:
    """prob, p, n: how many of either label have a score."""
    return df.groupBy("prob").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))


def auc(df: DataFrame) -> DataFrame:
    """Rank-sum AUC with ties counted half, from counts by distinct score; 0 with one class."""
    s = _running(_by_score(df), "prob", "n")
    a = s.agg(F.sum(F.col("p") * (F.col("before_n") + F.col("n") / 2)).alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return a.select(F.round(F.when(F.col("p") * F.col("n") == 0, 0.0).otherwise(F.col("u") / (F.col("p") * F.col("n"))), 6).alias("auc"))


def temperature(df: DataFrame, t: float) -> DataFrame:
    """Adds calibrated: sigmoid(logit(prob) / t); t of 0 or less counts as 1."""
    p = F.least(F.greatest(F.col("prob"), F.lit(1e-6)), F.lit(1 - 1e-6))
    return df.withColumn("calibrated", 1 / (1 + F.exp(-F.ln(p / (1 - p)) / (t if t > 0 else 1.0))))


def scores_at(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """accuracy, precision, recall, f1 and the counts they come from; 0 where a ratio has no denominator."""
    c = confusion(df, threshold)
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    values = {"accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)}
    return c.select("tp", "fp", "fn", "tn", *[F.round(v, 6).alias(k) for k, v in values.items()])


def roc_points(df: DataFrame) -> DataFrame:
    """threshold, tpr, fpr for every distinct score; a rate without a denominator is 0."""
    g = _by_score(df)
    every = g.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))  # one row
    s = _running(g, "prob", "p", "n", down=True).join(F.broadcast(every))
    rate = lambda c: F.round(F.coalesce(F.try_divide(F.col(f"before_{c}") + F.col(c), F.col(f"all_{c}")), F.lit(0.0)), 6)
    return s.select(F.col("prob").alias("threshold"), rate("p").alias("tpr"), rate("n").alias("fpr"))


def best_f1(df: DataFrame) -> DataFrame:
    """threshold, f1: over ascending distinct scores, each judged by precision and recall at the next higher one ((1, 0) after the last), the lowest of the best; 0.5 and -1 without scores. Recall is 1 where there are no positives."""
    g = df.groupBy("prob").agg(F.count_if(F.col("label") == 1).alias("p"), F.count(F.lit(1)).alias("m"))
    s = _running(g, "prob", "p", "m", down=True).join(F.broadcast(g.agg(F.sum("p").alias("pos"))))  # one row
    last = F.col("before_m") == 0
    precision = F.when(last, 1.0).otherwise(F.try_divide(F.col("before_p"), F.col("before_m")))
    recall = F.when(last, 0.0).when(F.col("pos") == 0, 1.0).otherwise(F.try_divide(F.col("before_p"), F.col("pos")))
    s = s.withColumn("a", precision).withColumn("b", recall).where("a + b > 0").withColumn("f1", F.round(2 * F.col("a") * F.col("b") / (F.col("a") + F.col("b")), 9))
    top = s.agg(F.max(F.struct("f1", (-F.col("prob")).alias("low"))).alias("m"))
    return top.select(F.coalesce(-F.col("m.low"), F.lit(0.5)).alias("threshold"), F.round(F.coalesce("m.f1", F.lit(-1.0)), 6).alias("f1"))


def trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """slope, intercept of the least-squares line over finite pairs."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    return df.where(ok(x) & ok(y)).agg(F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 6).alias("intercept"))


def cut_points(df: DataFrame, value: str, percent: float, iqr: float, sigma: float) -> DataFrame:
    """by_percentile, robust (median + iqr times the interquartile range) and moment (mean + sigma standard deviations) thresholds."""
    q = lambda p: F.percentile(value, F.lit(p))
    return df.agg(F.round(q(percent), 6).alias("by_percentile"), F.round(q(0.5) + iqr * (q(0.75) - q(0.25)), 6).alias("robust"), F.round(F.avg(value) + sigma * F.stddev_pop(value), 6).alias("moment"))


def tail_mean(df: DataFrame, order: str, value: str, n: int = 5) -> DataFrame:
    """Mean of the last n values."""
    return df.orderBy(F.desc(order)).limit(n).agg(F.round(F.avg(value), 6).alias("tail_mean"))


def fit_temperature(df: DataFrame, steps: int = 80, rate: float = 0.05) -> float:
    """The temperature that Adam finds for the log loss of (label, prob) in `steps` steps: that after the step with the lowest loss; 1 if it leaves (0, 1000) or there are no rows.

    Rows are counted by label and score once; each step is one aggregate of two sums over the counts, which are cached.
    """
    p = F.least(F.greatest(F.col("prob"), F.lit(1e-6)), F.lit(1 - 1e-6))
    counts = df.where("prob is not null and label in (0, 1)").groupBy(F.ln(p / (1 - p)).alias("z"), F.col("label").cast("double").alias("y")).agg(F.count(F.lit(1)).alias("c")).persist()
    try:
        s, m, v, best, found = 0.0, 0.0, 0.0, math.inf, 1.0
        for step in range(1, steps + 1):
            t = math.log1p(math.exp(s)) + 1e-6
            x = F.col("z") / t
            miss = 1 / (1 + F.exp(-x)) - F.col("y")
            n, loss, slope = counts.agg(F.sum("c"), F.sum(F.col("c") * (F.greatest(x, F.lit(0.0)) - x * F.col("y") + F.log1p(F.exp(-F.abs(x))))), F.sum(F.col("c") * miss * -x / t)).first()
            if not n:
                return 1.0
            g = slope / n / (1 + math.exp(-s))
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            s -= rate * (m / (1 - 0.9**step)) / (math.sqrt(v / (1 - 0.999**step)) + 1e-8)
            if loss / n < best:
                best, found = loss / n, math.log1p(math.exp(s)) + 1e-6
        return found if 0 < found < 1000 else 1.0
    finally:
        counts.unpersist()


def pair_means(df: DataFrame) -> DataFrame:
    """metric, model, mean of (metric, model, value) on the scale of figures, without the metrics that figures leave out."""
    kept = df.where(~F.col("metric").isin(*LEFT_OUT)).withColumn("value", scaled_metric(F.col("metric"), F.col("value")))
    return kept.groupBy("metric", "model").agg(F.avg("value").alias("mean"))


def delta_means(df: DataFrame) -> DataFrame:
    """metric, model, mean of how far prediction is from reference, in (metric, model, prediction, reference)."""
    d = df.withColumn("delta", scaled_delta(F.col("metric"), F.col("prediction") - F.col("reference")))
    return d.groupBy("metric", "model").agg(F.avg("delta").alias("mean"))


def finite(c) -> Column:
    """Whether a number is there, and is neither infinite nor none."""
    x = c.cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def without_outliers(df: DataFrame, value: str, factor: float = 1.5) -> DataFrame:
    """Rows whose finite value is at most factor times the quartiles' distance outside the quartiles of the finite values."""
    d = df.where(finite(F.col(value)))
    q = d.agg(F.percentile(value, F.lit(0.25)).alias("__q1"), F.percentile(value, F.lit(0.75)).alias("__q3"))  # one row
    spread = factor * (F.col("__q3") - F.col("__q1"))
    return d.join(F.broadcast(q)).where(F.col(value).between(F.col("__q1") - spread, F.col("__q3") + spread)).select(df.columns)


def whole_bins(df: DataFrame, value: str, width: int = 1) -> DataFrame:
    """lo, n, mean for the bins [lo, lo + width) that hold finite values, and the mean of all of them: the bars and the line of a figure of lengths."""
    d = df.where(finite(F.col(value))).select(F.col(value).cast("double").alias("x"))
    bins = d.groupBy((F.floor(F.col("x") / width) * width).cast("long").alias("lo")).agg(F.count(F.lit(1)).alias("n"))
    return bins.join(F.broadcast(d.agg(F.avg("x").alias("mean"))))  # one row


def mean_table(df: DataFrame, models: list[str]) -> DataFrame:
    """metric and a column for each of the models: pair_means() side by side, NaN where a metric has no values of a model."""
    wide = pair_means(df).groupBy("metric").pivot("model", models).agg(F.first("mean"))
    return wide.select("metric", *[F.coalesce(F.col(f"`{m}`"), F.lit(float("nan"))).alias(m) for m in models])


# The metrics of each level of a report.
LEVELS = {
    "L1": ("SentenceLengthVariability", "AvgSentenceLength", "SentenceComplexityIndex", "DependencyLength", "SemanticCohesion"),
    "L2": ("EntropyDensity", "CompressionDensity", "SyntacticDensity", "FleschKincaidScore", "GunningFogScore"),
    "L3": ("HierarchicalDensity", "SyntacticErrors"),
    "L4": ("LexicalDensity", "LexicalDiversity", "WordFrequencyEntropy", "SyllableDensity", "PPL"),
}


def by_level(df: DataFrame, *keys: str) -> DataFrame:
    """keys and a struct for each level, of its metrics that are columns of df; a level without any is left out."""
    found = {level: [m for m in names if m in df.columns] for level, names in LEVELS.items()}
    return df.select(*keys, *[F.struct(*names).alias(level) for level, names in found.items() if names])
