"""Quality rules as a short-circuit cascade: costs and rejections measured on a sample order the rules."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import erase, let, written

SPACE = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Measures:
    """What rules may read of a text, never null: columns that are there, or expressions that only a rule which reads them works out."""

    text: Column
    words: Column
    n_words: Column
    word_chars: Column
    n_symbols: Column
    n_lines: Column
    n_dup_lines: Column
    n_repeat_words: Column


@dataclass(frozen=True)
class Rule:
    """rejects(measures) is true where a text breaks the rule; an expression of built-in functions."""

    name: str
    rejects: Callable[[Measures], Column]


@dataclass(frozen=True)
class Estimate:
    """What a rule showed on the sample: seconds for a row and, in rejected, the share of the rows that reached its place in the cascade."""

    rule: Rule
    cost: float
    rejected: float


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))


def word_chars(w: Column) -> Column:
    return F.length(F.array_join(w, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long")


def repeated_lines(ls: Column) -> Column:
    """Of an array of lines, how many equal an earlier one."""
    return (F.size(ls) - F.size(F.array_distinct(ls))).cast("long")


WIDTH = 5


def windows(w: Column, width: int = WIDTH, seed: int = 1) -> Column:
    """Of an array of words, a hash of 64 bits for each window of `width` words."""
    return F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - (width - 1), F.lit(0))), lambda x, i: F.xxhash64(F.lit(seed), x, *[F.get(w, i + k) for k in range(1, width)]))


def repeated_words(w: Column, h: Column, width: int = WIDTH) -> Column:
    """Of an array of words with h, its windows(), how many words stand in a window that occurs at least twice.

    Windows that agree in h are compared by 64 more bits. A text without equal windows costs no more than its set of hashes.
    """

    def twice(s: Column, same: Callable[[Column], Column]) -> Column:
        """The elements of a sorted array that agree with a neighbour."""
        return F.filter(s, lambda x, k: F.coalesce(same(F.get(s, k - 1)) == same(x), F.lit(False)) | F.coalesce(same(F.get(s, k + 1)) == same(x), F.lit(False)))

    placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    alike = let(placed, lambda s: twice(s, lambda x: x["h"]))
    second = lambda i: F.xxhash64(F.lit(2), *[F.get(w, i + k) for k in range(width)])
    again = let(F.sort_array(F.transform(alike, lambda x: F.struct(x["h"].alias("h"), second(x["i"]).alias("g"), x["i"].alias("i")))), lambda s: twice(s, lambda x: F.struct(x["h"], x["g"])))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).alias("last"))
    covered = F.aggregate(F.sort_array(F.transform(again, lambda x: x["i"])), zero, lambda a, i: F.struct((a["n"] + F.least(F.lit(width), i - a["last"])).alias("n"), i.alias("last")))["n"]
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered)


def measures(t: Column, w: Column) -> Measures:
    """Every measure as an expression of a text and its words."""
    ls = lines(t)
    return Measures(t, w, F.size(w).cast("long"), word_chars(w), n_symbols(t), F.size(ls).cast("long"), let(ls, repeated_lines), let(windows(w), lambda h: repeated_words(w, h)))


def without_small_letters(t: Column) -> Column:
    """Words that hold no lower-case letter nor one of a script without case. Each place of the text is looked at once."""
    return F.regexp_count(t, F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{Ll}\p{Lo}]++(?![^\x20\x09-\x0D])"))


#: The two base rules: fewer than 10 words; over a fifth of the words stand in repeated windows of five.
BASE = (
    Rule("few_words", lambda m: m.n_words < 10),
    Rule("repeated_words", lambda m: 100 * m.n_repeat_words > 20 * m.n_words),
)

#: The other rules. All are shares of words or lines, so that long texts are judged as short ones.
FURTHER = (
    Rule("symbols", lambda m: 10 * m.n_symbols > m.n_words),
    Rule("repeated_lines", lambda m: 10 * m.n_dup_lines > 3 * m.n_lines),
    Rule("word_length", lambda m: let(m.word_chars, lambda n: (n < 2 * m.n_words) | (n > 20 * m.n_words))),
    Rule("no_small_letters", lambda m: 10 * without_small_letters(m.text) > 4 * m.n_words),
    Rule("exclamations", lambda m: F.length(m.text) - F.length(F.replace(m.text, F.lit("!"), F.lit(""))) > m.n_words),
)


def estimated(documents: DataFrame, rules: Sequence[Rule], text_col: str = "text", sample_rows: int = 2_000, seed: int = 11, runs: int = 2) -> list[Estimate]:
    """The rules in the order of the cascade, by a sample of about sample_rows rows (the bound, whatever the table's size).

    Each rule's cost is the least time of some runs over the sample less that of a run without a rule. The order is greedy: next comes
    the rule that rejects most, per cost, of the rows that the rules before it leave. A rule that rejects nothing there
    goes to the end, cheapest first. An empty table keeps the given order.
    """
    spark = documents.sparkSession
    if not (n := documents.count()):
        return [Estimate(r, 0.0, 0.0) for r in rules]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t")
    path, sample = written(documents.select(text).sample(min(1.0, sample_rows / n), seed).select("t", words(F.col("t")).alias("w")), keep_path=True)
    m = measures(F.col("t"), F.col("w"))

    def seconds(*columns: Column) -> float:
        took = []
        for _ in range(runs):
            began = time.perf_counter()
            sample.select("t", "w", *columns).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        return min(took)

    verdicts = sample.groupBy(*[r.rejects(m).alias(f"r{k}") for k, r in enumerate(rules)]).agg(F.count(F.lit(1)).alias("n")).collect()  # as many rows as the sample has, at most
    seconds()
    idle = seconds()
    rows = max(1, sum(v["n"] for v in verdicts))
    cost = [max(seconds(r.rejects(m)) - idle, 1e-4) / rows for r in rules]
    erase(spark, path)
    left, todo, out = [(v["n"], {k for k in range(len(rules)) if v[f"r{k}"]}) for v in verdicts], set(range(len(rules))), []
    while todo:
        reach = sum(n for n, _ in left)
        share = {k: sum(n for n, broken in left if k in broken) / reach if reach else 0.0 for k in todo}
        k = max(todo, key=lambda k: (share[k] / cost[k], -cost[k], -k))
        out.append(Estimate(rules[k], cost[k], share[k]))
        todo.remove(k)
        left = [x for x in left if k not in x[1]]
    return out


def first_broken(rules: Sequence[Rule], m: Measures) -> Column:
    """The name of the first rule broken, null if none: a CASE, whose later branches are not evaluated once one holds."""
    if not rules:
        return F.lit(None).cast("string")
    out = F.when(rules[0].rejects(m), rules[0].name)
    for r in rules[1:]:
        out = out.when(r.rejects(m), r.name)
    return out


def cascade(documents: DataFrame, rules: Sequence[Rule] = BASE + FURTHER, text_col: str = "text", into: str = "failed_rule", sample_rows: int = 2_000) -> DataFrame:
    """documents with one more column `into`: the rule that rejects the row, null for rows that stay.

    Rules run in the order that estimated() finds; a row pays only for the rules up to the one that rejects it. Whether a row stays doesn't
    depend on the order; which of several broken rules is named does. Only built-in expressions on one row: no shuffle. Null texts
    count as empty; whole texts of any length are judged; equal rows get equal verdicts; an empty table gives an empty one. Other columns pass
    unread; a column of the name `into` is replaced.
    """
    order = [e.rule for e in estimated(documents, rules, text_col, sample_rows)]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return documents.withColumn(into, let(words(text), lambda w: first_broken(order, measures(text, w))))


def measured_rules(documents: DataFrame, rules: Sequence[Rule] = FURTHER, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 2_000) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for every row.

    The base measures are due for every row, so the base rules read them and come first in the CASE; behind them stands the
    cascade of the further rules, in the order that estimated() finds on a sample of the rows. Cases are as in cascade(); null ids
    and repeated ids are rows like others.
    """
    order = [e.rule for e in estimated(documents, rules, text_col, sample_rows)]
    c, text, w = F.col, F.col("__text"), F.col("__words")
    d = documents.select(c(f"`{id_col}`").alias(id_col), F.coalesce(c(f"`{text_col}`").cast("string"), F.lit("")).alias("__text"))
    # Columns of their own, so that lambdas read them and don't work them out for each element.
    d = d.withColumn("__words", words(text)).withColumn("__windows", windows(w)).withColumn("__lines", lines(text))
    d = d.select(
        id_col, "__text", "__words", F.size("__lines").cast("long").alias("__n_lines"), F.size(w).cast("long").alias("n_words"), word_chars(w).alias("word_chars"),
        n_symbols(text).alias("n_symbols"), repeated_lines(c("__lines")).alias("n_dup_lines"), repeated_words(w, c("__windows")).alias("n_repeat_words"),
    )
    m = Measures(text, w, *map(c, ("n_words", "word_chars", "n_symbols", "__n_lines", "n_dup_lines", "n_repeat_words")))
    d = d.withColumn("base_failed", BASE[0].rejects(m) | BASE[1].rejects(m))
    kept = F.when(c("base_failed"), False).otherwise(first_broken(order, m).isNull())
    return d.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def sql(rules: Sequence[str] = tuple(r.name for r in FURTHER)) -> str:
    """The query's rows in SQL; each further rule in words of its own."""
    broken = {
        "symbols": "10 * n_symbols > n_words",
        "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
        "word_length": "word_chars < 2 * n_words or word_chars > 20 * n_words",
        "no_small_letters": r"10 * len(list_filter(w, lambda x: not regexp_matches(x, '[\p{Ll}\p{Lo}]'))) > 4 * n_words",
        "exclamations": "length(t) - length(replace(t, '!', '')) > n_words",
    }
    return rf"""with a as (select doc_id, coalesce(text, '') as t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from documents),
g as (select doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4])) as g, unnest(range(1, len(w) - 3)) as i from a),
k as (select doc_id, i, count(*) over (partition by doc_id, g) as c from g),
p as (select doc_id, count(distinct i + j) as n from k, (values (0), (1), (2), (3), (4)) as t(j) where c > 1 group by doc_id),
m as (select doc_id, t, w, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
len(l) as n_lines, len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(n, 0) as n_repeat_words from a left join p using (doc_id)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not (base_failed or {" or ".join(broken[r] for r in rules)}) as kept from b"""
