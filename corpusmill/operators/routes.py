"""Three routes of vectors and metrics joined to one probability: the original text, the perturbed one and the restored one."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROUTES = ("original", "perturbed", "restored")


@dataclass(frozen=True)
class Linear:
    """x -> w x + b, and then, with a norm (mean, variance, scale, shift of each output), the normalised outputs."""

    w: np.ndarray
    b: np.ndarray
    norm: np.ndarray | None = None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        y = x @ self.w.T + self.b
        if self.norm is not None:
            mean, variance, scale, shift = self.norm
            y = (y - mean) / np.sqrt(variance + 1e-5) * scale + shift
        return y


@dataclass(frozen=True)
class Stack:
    """Linear steps with a rectifier behind each; with residual, what the first gives is added to what the last gives."""

    steps: tuple[Linear, ...]
    residual: bool = False

    def __call__(self, x: np.ndarray) -> np.ndarray:
        first = out = np.maximum(self.steps[0](x), 0)
        for s in self.steps[1:]:
            out = np.maximum(s(out), 0)
        return out + first if self.residual else out


@dataclass(frozen=True)
class JointClassifier:
    """A stack for each route, one for all of their outputs side by side, and one output."""

    routes: tuple[Stack, ...]
    fusion: Stack
    out: Linear

    def probability(self, inputs: list[np.ndarray]) -> np.ndarray:
        """Of rows: a matrix (rows, width) for each route."""
        logit = self.out(self.fusion(np.concatenate([r(x) for r, x in zip(self.routes, inputs)], axis=1)))[:, 0]
        return 1 / (1 + np.exp(-logit))


def layer_shapes(width: int, hidden: int, fusion: int, depth: int = 1) -> dict[str, tuple[int, int]]:
    """name -> (outputs, inputs) of every linear step: depth 1 is the plain form, more the deep one with norms and residuals."""
    shapes = {}
    for r in ROUTES:
        shapes |= {f"{r}/{k}": (hidden, width if k == 0 else hidden) for k in range(depth)}
    shapes |= {f"fusion/{k}": (fusion, 3 * hidden if k == 0 else fusion) for k in range(depth)}
    return shapes | {"out/0": (1, fusion)}


def seeded_weights(spark: SparkSession, width: int, hidden: int = 256, fusion: int = 512, depth: int = 1, seed: int = 42) -> DataFrame:
    """step, row, col, value: weights evenly spread within 1 / sqrt(inputs) of 0, by a hash of their place; col -1 is the bias, and of deep forms -2 to -5 are mean, variance, scale and shift of the norm."""
    s = spark.createDataFrame([(n, o, i) for n, (o, i) in layer_shapes(width, hidden, fusion, depth).items()], "step string, outputs int, inputs int")
    low = F.when((F.lit(depth) > 1) & ~F.col("step").startswith("out"), F.lit(-5)).otherwise(F.lit(-1))
    s = s.withColumn("row", F.explode(F.expr("sequence(0, outputs - 1)"))).withColumn("col", F.explode(F.sequence(low, F.col("inputs") - 1)))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "step", "row", "col").cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    spread = (2 * u - 1) / F.sqrt(F.col("inputs").cast("double"))
    return s.select("step", "row", "col", F.when(F.col("col").isin(-3, -4), 1 + spread).otherwise(spread).alias("value"))


def load(weights: DataFrame, depth: int = 1) -> JointClassifier:
    """The classifier of a table such as seeded_weights(), whose size is that of the model and not of any data."""
    t = weights.toPandas()
    steps = {}
    for name, g in t.groupby("step"):
        m = g.pivot(index="row", columns="col", values="value")
        steps[name] = Linear(m[[c for c in m if c >= 0]].to_numpy(), m[-1].to_numpy(), m[[-2, -3, -4, -5]].to_numpy().T if -5 in m else None)
    stack = lambda name: Stack(tuple(steps[f"{name}/{k}"] for k in range(depth)), depth > 1)
    return JointClassifier(tuple(map(stack, ROUTES)), stack("fusion"), steps["out/0"])


def classified(df: DataFrame, id_col: str, model: JointClassifier, threshold: float = 0.5) -> DataFrame:
    """id, prob, pred (1 above the threshold) for rows with <route>_vector and <route>_metrics arrays of doubles for each of ROUTES.

    Batches are matrices; the model goes to each task once. A row in which any array is null has a null prob and pred.
    """
    cols = [f"{r}_{k}" for r in ROUTES for k in ("vector", "metrics")]

    def run(batches):
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns[1:])))
            whole = [i for i, r in enumerate(rows) if None not in r]
            found = dict(zip(whole, model.probability([np.array([rows[i][2 * k] + rows[i][2 * k + 1] for i in whole], float) for k in range(3)]).tolist())) if whole else {}
            prob = [found.get(i) for i in range(len(rows))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prob, pa.float64()), pa.array([None if p is None else int(p > threshold) for p in prob], pa.int32())], names=[id_col, "prob", "pred"])

    return df.select(id_col, *cols).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, prob double, pred int")
