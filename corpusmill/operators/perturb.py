"""Perturbations of sentence lists. Their draws depend on a list's length and the strength only, so they are made once on the driver and applied as array expressions."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import rewrite
from corpusmill.functions.metrics import sentences as split
from corpusmill.operators.stored import spread

SEED = 42
# Fixed values.
PASSIVE_TAIL, NOMINAL_HEAD = " , which is reported by prior work .", "The analysis of "


def global_order(n: int, strength: float) -> list[int]:
    """Which sentence comes at each place when a share of all places is drawn and permuted."""
    order = list(range(n))
    if n > 1 and strength > 0:
        draw = random.Random(SEED)
        places = list(range(n))
        draw.shuffle(places)
        places = sorted(places[: max(1, round(n * min(1.0, strength)))])
        moved = places.copy()
        draw.shuffle(moved)
        for to, of in zip(places, moved):
            order[to] = of
    return order


def block_order(n: int, strength: float) -> list[int]:
    """Which sentence comes at each place when blocks, shorter for more strength, are permuted."""
    if n <= 2 or strength <= 0:
        return list(range(n))
    size = min(n, max(1, round((1.0 - min(1.0, strength)) * n)))
    starts = list(range(0, n, size))
    random.Random(SEED).shuffle(starts)
    return [i for s in starts for i in range(s, min(n, s + size))]


def reordered(df: DataFrame, column: str, order, strength: float) -> DataFrame:
    """df with the arrays of column in the order that order(length, strength) gives, in Arrow batches; null stays null."""
    return df.withColumn(column, rewrite.on_lists(F.col(column), _ordered, strength, order))


def _ordered(sentences: list[str], strength: float, order) -> list[str]:
    return [sentences[i] for i in order(len(sentences), strength)]


def _framed(sentences: list[str], strength: float, new) -> list[str]:
    draw = random.Random(SEED)
    return [new(s) if strength > 0 and draw.random() < strength and len(s.split()) > 6 else s for s in sentences]


#: Strategies by the name an option carries.
STRATEGIES = {
    "none": lambda s, p: s,
    "global_shuffle": lambda s, p: _ordered(s, p, global_order),
    "block_shuffle": lambda s, p: _ordered(s, p, block_order),
    "intra_shuffle": rewrite.window_shuffled,
    "function_word_sub": rewrite.function_words,
    "passive": lambda s, p: _framed(s, p, lambda x: x + PASSIVE_TAIL),
    "nominal": lambda s, p: _framed(s, p, lambda x: NOMINAL_HEAD + x),
    "synonym": rewrite.synonyms,
}


def applied(sentences: list[str], option: str) -> list[str]:
    """sentences under an option such as 'synonym_0.20'; an unknown one raises."""
    name, _, strength = option.rpartition("_")
    try:
        p = float(strength)
    except ValueError:
        p = 0.0
    return STRATEGIES[name or option](sentences, p)


def layered(df: DataFrame, id_col: str, text_col: str, choose) -> DataFrame:
    """id, reordered, perturbed: order, syntax and words are perturbed in turn by choose(layer, text so far, its options); `reordered` is the text after the first."""
    import pyarrow as pa

    def run(batches):
        for b in (x.slice(i, 256) for x in batches for i in range(0, len(x), 256)):
            first, last = [], []
            for text in b.column(1).to_pylist():
                s = split(text or "")
                for layer, options in rewrite.LAYERS.items():
                    s = applied(s, choose(layer, " ".join(s), options))
                    if layer == "O":
                        first.append(" ".join(s))
                last.append(" ".join(s))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(first, pa.string()), pa.array(last, pa.string())], names=[id_col, "reordered", "perturbed"])

    return spread(df.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, reordered string, perturbed string")
