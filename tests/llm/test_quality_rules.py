import random
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from corpusmill.llm import quality_rules as Q
from corpusmill.llm import queries

SF = "/root/testdata/sf0.001"


def measured(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many = Counter(windows)
    again = {p for i, x in enumerate(windows) if many[x] > 1 for p in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), len(w) < 10 or 100 * len(again) > 20 * len(w)


def further(t):
    n, chars, symbols, dup, _, _ = measured(t)
    w = t.split()
    lines = sum(bool(x.strip()) for x in t.split("\n"))
    small = sum(not any(c.islower() for c in x) for x in w)
    return 10 * symbols > n or 10 * dup > 3 * lines or chars < 2 * n or chars > 20 * n or 10 * small > 4 * n or t.count("!") > n


def texts():
    r = random.Random(5)
    some = lambda n, k: " ".join(f"w{r.randrange(k)}" for _ in range(n))
    out = [None, "", " \t\n", "a b c", some(300, 6), some(300, 3), some(40, 1), some(500, 4000), "x y z v w\n" * 9, "one two\n\n \none two\nthree", "é" * 30 + " " + some(12, 99), "# * | < > " * 4, "WORD! " * 30, " a b" * 20]
    passage = some(7, 99)
    out += [f"{some(60, 9999)} {passage} {some(60, 9999)} {passage} {some(3, 9999)} {passage}", "aa ! " * 20, some(20_000, 900) + " " + some(20_000, 900)]
    return out + [some(r.randrange(5, 60), r.randrange(2, 9)) for _ in range(60)]


def test_measures_and_verdicts_against_brute_force(spark):
    ts = texts() + [None, "a b c"]
    df = spark.createDataFrame([(None if i == 3 else i // 2, t, "x", True, "k") for i, t in enumerate(ts)], "doc_id long, text string, source string, kept boolean, n_words string")
    got = Q.measured_rules(df.withColumn("__text", F.lit("clash"))).collect()
    want = [(None if i == 3 else i // 2, *(m := measured(t)), not (m[-1] or further(t))) for i, t in enumerate(ts)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert any(w[-1] for w in want)


def test_cascade_stops_at_the_first_broken_rule_and_keeps_all_columns(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts())], "id long, text string, failed_rule string")
    got = {r["id"]: r["failed_rule"] for r in Q.cascade(df).collect()}
    for i, t in enumerate(texts()):
        assert (got[i] is None) == (not measured(t)[-1] and not further(t or "")), t
    assert Q.cascade(df).columns == df.columns
    assert Q.cascade(df.limit(0)).collect() == [] and Q.measured_rules(df.limit(0), id_col="id").collect() == []
    assert all(r["failed_rule"] is None for r in Q.cascade(df, rules=()).collect())


def test_order_is_by_rejection_per_cost_of_what_is_left(spark):
    df = spark.range(400).select(F.concat(F.lit("t"), F.col("id")).alias("text"))
    number = lambda m: F.substring(m.text, 2, 9).cast("int")
    slow = lambda m: F.aggregate(F.sequence(F.lit(1), F.lit(20_000)), F.lit(0), lambda a, x: (a + x * 7) % 1_000)
    rules = [Q.Rule("slow", lambda m: (slow(m) >= 0) & (number(m) < 220)), Q.Rule("never", lambda m: number(m) < 0), Q.Rule("few", lambda m: number(m) >= 380), Q.Rule("half", lambda m: number(m) < 200)]
    order = Q.estimated(df, rules)
    names = [e.rule.name for e in order]
    assert names[-1] == "never" and names.index("half") < names.index("slow") and names.index("few") < names.index("slow")
    at = {e.rule.name: e for e in order}
    assert at["slow"].cost > at["half"].cost and at["half"].rejected == 0.5 or at["few"].rejected in (0.05, 0.1)
    got = {r["failed_rule"]: r["n"] for r in Q.cascade(df, rules).groupBy("failed_rule").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"half": 200, "slow": 20, "few": 20, None: 160}


def test_query_equals_its_sql_and_runs_no_python(spark):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = queries.op13_quality_rules(spark, SF)
    want = c.execute(queries.oracle_sql()["op13_quality_rules"])
    assert [x[0] for x in want.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
