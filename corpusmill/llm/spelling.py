"""Spelling variants: words one edit apart, met by an even-partition pigeonhole join, grouped under their commonest form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import erase, written

#: Maximal runs of these are words.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(run: Column) -> Column:
    """run with A-Z in lower case and no other letter changed."""
    return F.when(F.length(run) == F.octet_length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def with_a_slip(id_text: Column, word: Column, every: int = 97) -> Column:
    """word without one code point where the CRC-32 of `id:word` is a multiple of `every`; the same number says which one."""
    h = F.crc32(F.concat(id_text, F.lit(":"), word).cast("binary"))
    at = F.pmod(h, F.greatest(F.length(word), F.lit(1))).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def word_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 5, min_count: int = 3, respell: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """word, n: the words of whole texts, of min_length code points or more, that occur min_count times or more.

    respell(id as text, word) may change a word before it is counted; it may shorten words but not lengthen them. Null texts have no words; a null id is
    the empty text. Counts combine before the shuffle, so a word that holds a third of all occurrences is one row of each task.
    """
    d = documents.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(f"`{text_col}`").cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    d = d.where(F.length("run") >= min_length).select("id", lowered(F.col("run")).alias("word"))
    if respell:
        d = d.select(respell(F.col("id"), F.col("word")).alias("word")).where(F.length("word") >= min_length)
    return d.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _half(size: Column) -> Column:
    return F.floor(size / 2).cast("int")


def one_edit_pairs(words: DataFrame) -> DataFrame:
    """(a, na, b, nb): every unordered pair of words(word, n) that differ by one inserted, deleted or replaced code point, once.

    A word of l code points is indexed by two segments: its first l // 2 code points and the rest. One edit leaves one of them whole, so a word of
    length l probes with its own segments, and one of length l + 1 with its first l // 2 code points and, shifted by one, its last l - l // 2. Of equal
    lengths the smaller word probes. A pair that both segments bring up is taken by the first: the second asks that the first differ. The
    distance is checked inside the join, so that candidates are not written anywhere. Words are distinct and not empty.
    """
    size = F.length("word")
    segment = lambda no, start, n, of: F.struct(F.lit(no).alias("no"), of.alias("of"), F.substring("word", start, n).alias("part"))
    index = words.select(F.col("word").alias("a"), F.col("n").alias("na"), F.explode(F.array(segment(1, F.lit(1), _half(size), size), segment(2, _half(size) + 1, size, size))).alias("s"))
    less = size - 1
    own = [segment(1, F.lit(1), _half(size), size), segment(2, _half(size) + 1, size, size)]
    longer = [segment(1, F.lit(1), _half(less), less), segment(2, _half(less) + 2, size, less)]
    probes = words.select(F.col("word").alias("b"), F.col("n").alias("nb"), F.explode(F.array(*own, *longer)).alias("s"))
    index, probes = index.select("a", "na", "s.*"), probes.select("b", "nb", "s.*")
    # Where the first halves agree as well, segment 1 has brought the pair up.
    half = _half(F.col("of"))
    first = (F.col("no") == 1) | (F.substring("a", F.lit(1), half) != F.substring("b", F.lit(1), half))
    ordered = (F.length("b") > F.col("of")) | (F.col("b") < F.col("a"))
    return index.join(probes, ["no", "of", "part"]).where(ordered & first & (F.levenshtein("a", "b", 1) == 1)).select("a", "na", "b", "nb")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of the chain from word over form, for forms(word, form) without a cycle.

    Each round doubles the steps: a word's form becomes its form's form. With n at least doubling from word to form a chain has at most log2 of the largest n steps,
    so there are few rounds. A form that many words share is a hot key on one side only, where Spark may split it.
    """
    spark, path, up = forms.sparkSession, *written(forms.select("word", F.col("form").alias("root")), keep_path=True)
    while True:
        above = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new_path, new = written(up.join(above, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), keep_path=True)
        erase(spark, path)
        path, up = new_path, new.select("word", "root")
        if new.where("moved").isEmpty():
            return up


def spelling_variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of words(word, n), whose words are distinct.

    n_near counts the words one edit away. form is the one of them of largest n (ties: the smallest in code-point order), if that n is at least
    ratio (over 1) times the word's own, else null; form_n is its n. root is the end of the chain of forms, the word itself without one. Counts and best forms
    combine before the shuffle. An empty table gives an empty one; other columns aren't read. Words of any length are compared whole.
    """
    words = written(words.select("word", F.col("n").cast("long").alias("n")))
    pairs = one_edit_pairs(words)
    sides = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("na").alias("n"), F.col("b").alias("near"), F.col("nb").alias("m")), F.struct(F.col("b").alias("word"), F.col("nb").alias("n"), F.col("a").alias("near"), F.col("na").alias("m")))).alias("p")).select("p.*")
    best = sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("near").alias("w"))).alias("top"), F.first("n").alias("n"))
    is_form = -F.col("top.m") >= ratio * F.col("n")
    best = written(best.select("word", "n_near", F.when(is_form, F.col("top.w")).alias("form"), F.when(is_form, -F.col("top.m")).alias("form_n")))
    top = roots(best.where("form is not null"))
    out = words.join(best, "word", "left").join(top, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("form_n").cast("long").alias("form_n"))
