"""A small network that chooses how strongly a text is perturbed, layer by layer."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import metrics, rewrite
from corpusmill.operators import perturb

# The five features of each layer, by their names in reports, and the metric of ours that gives them; those that need a parser or a model give 0.
FEATURES = {
    "O": ("SentenceLengthVariability", "AvgSentenceLength", "SentenceComplexityIndex", "DependencyLength", "SemanticCohesion"),
    "S": ("SyntacticDensity", "FleschKincaidScore", "GunningFogScore", "HierarchicalDensity", "SyntacticErrors"),
    "L": ("LexicalDensity", "LexicalDiversity", "WordFrequencyEntropy", "SyllableDensity", "PPL"),
}
MEASURED = {"SentenceLengthVariability": "sentence_variability", "AvgSentenceLength": "sentence_length", "FleschKincaidScore": "reading_ease", "GunningFogScore": "fog", "LexicalDiversity": "diversity", "WordFrequencyEntropy": "word_entropy", "SyllableDensity": "syllable_density"}
HIDDEN = 64


def layer_features(layer: str, text: str, more=None) -> list[float]:
    """The features of a layer, measured on text; more(text) may give those that need a model, by name."""
    own = metrics.text_metrics(text)
    found = {name: own[m] for name, m in MEASURED.items()} | (more(text) if more else {})
    return [float(found.get(name, 0.0)) for name in FEATURES[layer]]


@dataclass(frozen=True)
class Network:
    """Two linear steps with a rectifier between: (hidden, inputs), hidden; (options, hidden), options."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def logits(self, features: list[float]) -> np.ndarray:
        return self.w2 @ np.maximum(self.w1 @ np.asarray(features, float) + self.b1, 0.0) + self.b2

    def choice(self, features: list[float]) -> int:
        """The first of the largest."""
        return int(np.argmax(self.logits(features)))


def seeded_weights(spark: SparkSession, seed: int = 42, hidden: int = HIDDEN) -> DataFrame:
    """layer, part (w1, b1, w2, b2), row, col, value: weights evenly spread within 1 / sqrt(inputs) of 0, by a hash of their place."""
    shapes = []
    for layer, names in FEATURES.items():
        k = len(rewrite.LAYERS[layer])
        shapes += [(layer, "w1", hidden, len(names), len(names)), (layer, "b1", hidden, 1, len(names)), (layer, "w2", k, hidden, hidden), (layer, "b2", k, 1, hidden)]
    s = spark.createDataFrame(shapes, "layer string, part string, rows int, cols int, inputs int")
    s = s.withColumn("row", F.explode(F.expr("sequence(0, rows - 1)"))).withColumn("col", F.explode(F.expr("sequence(0, cols - 1)")))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "layer", "part", "row", "col").cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return s.select("layer", "part", "row", "col", ((2 * u - 1) / F.sqrt(F.col("inputs").cast("double"))).alias("value"))


def load(weights: DataFrame) -> dict[str, Network]:
    """The network of each layer from a table such as seeded_weights(), whose size the layers bound: a few thousand values."""
    held: dict[tuple[str, str], dict] = {}
    for r in weights.collect():
        held.setdefault((r["layer"], r["part"]), {})[r["row"], r["col"]] = r["value"]
    matrix = lambda d: np.array([[d[i, j] for j in range(1 + max(c for _, c in d))] for i in range(1 + max(r for r, _ in d))], float)
    return {layer: Network(*(matrix(held[layer, p]) if p[0] == "w" else matrix(held[layer, p])[:, 0] for p in ("w1", "b1", "w2", "b2"))) for layer in FEATURES}


def chooser(networks: dict[str, Network], more=None):
    """What perturb.layered() takes: the option that a layer's network prefers for the text as it stands, measured anew."""
    return lambda layer, text, options: options[networks[layer].choice(layer_features(layer, text, more))]


def perturbed(df: DataFrame, id_col: str, text_col: str, weights: DataFrame, more=None) -> DataFrame:
    """id, reordered, perturbed under the options that the networks of weights choose."""
    return perturb.layered(df, id_col, text_col, chooser(load(weights), more))
