"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

# Insults that stand in the lexicon whatever the labels say (a trailing * matches as a
# stem), phrases in which such a word is no insult, look-alike letters, and digits read as letters.
SEEDS = (
    "arsehole asshole bastard bitch bullshit cretin cunt dickhead disgusting dumbass fuck* idiot idiots imbecile loser losers moron morons "
    "pathetic prick scum scumbag shithead slut stupid trash whore worthless abschaum arschloch dummkopf hurensohn schlampe vollidiot wichser "
    "connard connasse encule enfoire salaud salope cabron gilipollas idiota imbecil pendejo puta"
).split()
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "class clown", "clown fish", "clown car", "pathetic fallacy", "sore loser board game", "stupid question of mine", "pond scum", "the idiot by dostoevsky")
# Look-alikes are those of Latin letters in Unicode's confusables.txt (UTS 39), by block: Cyrillic, Greek, Latin.
HOMOGLYPHS = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухѵһԁԛԝӏ", "ABESIJKMHOPCTYXaesijopcyxvhdqwl")) | dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγινορυ", "ABEZHIKMNOPTYXayivopu")) | dict(zip("ıɑɡɩᴏᴜᴠᴡᴢøłđæœ", [*"iagiouvwzold", "ae", "oe"]))
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"}

_TABLE: dict = {}
_MIXED = re.compile(r"[^\W\d_](?:[\d@$!|]+[^\W\d_])+|[\d@$|]+[^\W\d_](?:[\d@$!|]*[^\W\d_])*")
_WIDE = re.compile(r"(?<![\d@$!|])[\d@$!|]*+[^\W\d_](?:[\d@$!|]*[^\W\d_])*[\d@$]*")

_SIGNED = re.compile(r"(?<!\S)[^\s\d@$!|]*+[\d@$!|]\S*+")


def _fold_char(c: str) -> str:
    """A lower-case base letter or digit; any other character becomes a space, a zero-width one or an accent vanishes."""
    kind = unicodedata.category(c)
    if kind in ("Cf", "Mn"):
        return ""
    base = "".join(HOMOGLYPHS.get(x, x) for x in unicodedata.normalize("NFKD", c) if unicodedata.category(x) != "Mn").casefold()
    return base if base.isalnum() else " "


class _Folding(dict):
    def __missing__(self, code: int) -> str:
        self[code] = out = _fold_char(chr(code))
        return out


def fold(text: str) -> str:
    """text for matching: digits and signs within words read as letters, look-alikes and accents folded, other characters spaces.

    Digits are read as letters only in runs before a letter of their word, so numbers stay numbers; widely() reads
    those at a word's end too.
    """
    if not _TABLE:
        _TABLE["t"] = _Folding()
    letters = lambda m: "".join(DIGITS.get(c, c) for c in m[0])
    return _SIGNED.sub(lambda m: _MIXED.sub(letters, m[0]), text).translate(_TABLE["t"])


def widely(text: str, folded: str) -> str | None:
    """The other reading of fold(text): all digits and signs at a word's start and end are letters too (whor3, dumba$$, !d10t). None if it is the same.

    A sign is one character in either reading, so places agree. Only words that hold a digit or sign are read again.
    """
    letters = lambda m: "".join(DIGITS.get(c, c) for c in m[0])
    again = _SIGNED.sub(lambda m: _WIDE.sub(letters, m[0]), text)
    if again == text:
        return None
    wide = again.translate(_TABLE["t"])
    return None if wide == folded else wide


@dataclass
class Lexicon:
    """entries: folded word, or stem with a trailing *, to weight; a logistic curve over two features gives the score."""

    entries: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-3.0, 1.5, 1.0)
    bound: dict = field(default_factory=dict)

    def automaton(self):
        a = ahocorasick.Automaton()
        kinds: dict[str, list] = {}
        for k, w in self.entries.items():
            stem = k.endswith("*")
            kinds.setdefault(" " + k.rstrip("*"), []).append((stem, w))
        for k in self.exceptions:
            kinds.setdefault(" " + k, []).append((None, 0.0))
        for k, v in kinds.items():
            a.add_word(k, (len(k), v))
        if kinds:
            a.make_automaton()
        return a if kinds else None

    def mass(self, text: str, automaton) -> tuple[float, int, int]:
        """(weight of the matches, their number, words). An occurrence inside an exception phrase doesn't count; of several entries at one word the heaviest does. Words match by either reading of their digits."""
        once = fold(text)
        folded = f" {once} "
        words = len(folded.split())
        if automaton is None:
            return 0.0, 0, words
        best: dict[int, float] = {}
        safe: list[tuple[int, int]] = []
        other = widely(text, once)
        for reading in (folded,) if other is None else (folded, f" {other} "):
            for end, (n, kinds) in automaton.iter(reading):
                start = end - n + 1
                closed = reading[end + 1] == " " if end + 1 < len(reading) else True
                for stem, w in kinds:
                    if stem is None:
                        if closed:
                            safe.append((start, end))
                    elif stem or closed:
                        best[start] = max(best.get(start, 0.0), w)
        if safe:
            best = outside(best, safe)
        return sum(best.values()), len(best), words

    def score(self, mass: float, words: int) -> float:
        return 1 / (1 + math.exp(-min(50.0, max(-50.0, float(np.dot(self.curve, features(mass, words)))))))


def outside(best: dict[int, float], spans: list[tuple[int, int]]) -> dict[int, float]:
    """The places of best that lie in none of the spans [a, z), by one sweep over both in order."""
    spans, at, end, out = sorted(spans), 0, -1, {}
    for k in sorted(best):
        while at < len(spans) and spans[at][0] <= k:
            end, at = max(end, spans[at][1]), at + 1
        if k >= end:
            out[k] = best[k]
    return out


def features(mass: float, words: int) -> tuple[float, float, float]:
    """Constant, total weight and weight for each hundred words, both by log1p: length counts, a long text can't hide its insults."""
    return 1.0, math.log1p(mass), math.log1p(100 * mass / max(words, 1))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 4 == 2


def learn(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 12_000, min_docs: int = 4, min_odds: float = 20.0) -> Lexicon:
    """A lexicon from at most sample_rows labelled rows of documents (the bound, by order of a hash, also where ids repeat) that are not held out.

    Counts, for whole folded words of 4 letters or more and for their stems of 4 to 8 letters, the toxic and other sample texts that
    hold them; keeps all that min_docs toxic texts hold and that are min_odds times likelier in toxic ones. The sample
    alone bounds them. Seeds stay in. A stem that a shorter kept stem explains as well is dropped. The score's curve is fitted to the
    same sample by Newton steps. Without labelled rows of both kinds the seeds and a fixed curve remain.
    """
    key = F.col(id_col)
    named = labels.where(key.isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col)).groupBy(key.alias("__id")).agg(F.max(label_col).alias("__y"))
    chosen = named.orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)
    labelled = documents.select(key.alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).join(F.broadcast(chosen), "__id")
    sample = labelled.orderBy(F.xxhash64("__id", "__text"), "__id", "__y").limit(sample_rows).select("__y", "__text").repartition(max(1, sample_rows // 400))

    def count(batches):
        toxic: Counter = Counter()
        other: Counter = Counter()
        n = [0, 0]
        for b in batches:
            for y, text in zip(b.column(0).to_pylist(), b.column(1)):
                grams = set()
                for w in set(fold(text.as_py()).split()):
                    if len(w) >= 4:
                        grams.add(w)
                        grams.update(w[:k] + "*" for k in range(4, min(len(w), 9)))
                (toxic if y else other).update(grams)
                n[bool(y)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(["", *toxic, *other]), pa.array([n[1], *toxic.values(), *[0] * len(other)], pa.int64()), pa.array([n[0], *[0] * len(toxic), *other.values()], pa.int64())], names=["gram", "t", "o"])

    grams = sample.mapInArrow(count, "gram string, t long, o long").groupBy("gram").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    grams = written(grams)
    total = grams.where("gram = ''").first()
    entries = {s: 3.0 for s in SEEDS}
    if total is None or not total["o"] or not total["t"]:
        return Lexicon(entries)
    log_odds = F.log((F.col("t") + 0.5) / (total["t"] + 1)) - F.log((F.col("o") + 0.5) / (total["o"] + 1))
    top = grams.where(F.col("t") >= min_docs).where("gram <> ''").withColumn("odds", log_odds).where(F.col("odds") >= math.log(min_odds)).collect()
    odds = {r["gram"]: r["odds"] for r in top}
    kept: dict[str, float] = {}
    for g in sorted(odds, key=lambda g: (len(g.rstrip("*")), g)):
        shorter = [kept[p] for k in range(4, len(g.rstrip("*")) + 1) if (p := g.rstrip("*")[:k] + "*") in kept and p != g]
        if not shorter or max(shorter) < odds[g] - 1:
            kept[g] = odds[g]
    lexicon = Lexicon(entries | kept, bound={"sample_rows": sample_rows})
    rows = measured(sample.select(F.col("__y").alias("y"), "__text"), lexicon, "y", "__text").select("y", "mass", "words").collect()
    lexicon.curve = fit([features(r["mass"], r["words"]) for r in rows], [r["y"] for r in rows])
    return lexicon


def fit(x: list, y: list, ridge: float = 1e-2, steps: int = 40) -> tuple[float, float, float]:
    """Logistic regression by Newton steps with a small ridge; needs both classes, else the fixed curve stays."""
    if len(set(y)) < 2:
        return Lexicon({}).curve
    a, t, w = np.asarray(x, float), np.asarray(y, float), np.zeros(3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(3), a.T @ (t - p) - ridge * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w)


def clean(documents: DataFrame, lexicon: Lexicon, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of documents that aren't predicted toxic, in all their columns; each row is judged by its own whole text, whatever its id. Null and empty texts are clean; an empty table gives an empty one."""
    at = documents.columns.index(text_col)

    def run(batches):
        automaton = lexicon.automaton()
        for b in batches:
            found = (lexicon.mass(t.as_py() or "", automaton) for t in b.column(at))
            yield b.filter(pa.array([lexicon.score(m, w) < threshold for m, _, w in found], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def measured(df: DataFrame, lexicon: Lexicon, key: str, text_col: str) -> DataFrame:
    """key, score, mass, matches and words for each row of df; a null text counts as empty."""

    def run(batches):
        automaton = lexicon.automaton()
        for b in batches:
            found = [lexicon.mass(t.as_py() or "", automaton) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([lexicon.score(m, w) for m, _, w in found], pa.float64()), pa.array([m for m, _, _ in found], pa.float64()), pa.array([n for _, n, _ in found], pa.int64()), pa.array([w for _, _, w in found], pa.int64())],
                names=[key, "score", "mass", "matches", "words"],
            )

    return df.select(key, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, score double, mass double, matches long, words long")


def toxicity(documents: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """id, held_out, score, predicted (score >= threshold), mass, matches, words for every row.

    Whole texts are folded and matched; null and empty texts get the score of no match. Repeated rows give
    equal scores. Only the text enters the score. Other columns are not read.
    """
    scored = measured(documents, lexicon, id_col, text_col)
    return scored.select(id_col, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "mass", "matches", "words")
