import math
import random
import re
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from corpusmill.functions import metrics
from corpusmill.functions import text as T
from corpusmill.operators import dedup, evaluation, neardup, perturb, sequences
from corpusmill.plans import catalogue
from corpusmill.sources import files
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return float(v) if isinstance(v, (Decimal, float)) else v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    want = duck.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    a, b = rows(got.columns, got.collect()), rows(columns, want.fetchall())
    assert len(a) == len(b) > 0
    for x, y in zip(a, b):
        assert all(p == q or isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, abs_tol=1e-6) for p, q in zip(x, y)), (x, y)


def test_text_metrics_agree_with_sql_within_the_last_place(spark, duck):
    got = catalogue.queries()["text_metrics"](spark, SF)
    want = duck.execute(catalogue.TEXT_METRICS_SQL)
    columns = [c[0] for c in want.description]
    a, b = ({r["doc_id"]: r for r in x} for x in (got.collect(), [dict(zip(columns, r)) for r in want.fetchall()]))
    assert sorted(columns) == sorted(got.columns) and a.keys() == b.keys()
    assert all(math.isclose(a[k][c], b[k][c], abs_tol=1.01e-4) for k in a for c in columns)


@pytest.mark.parametrize("name", sorted(catalogue.queries().keys() - catalogue.oracle_sql().keys()))
def test_query_without_sql_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def naive_edit(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


def naive_lcs(a, b):
    d = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], last + 1 if x == y else max(d[j], d[j - 1])
    return d[-1]


def test_bitwise_distances_against_brute_force():
    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choice("abé日") for _ in range(r.randrange(0, 90))) for _ in "ab")
        assert metrics.edit_distance(a, b) == naive_edit(a, b) and metrics.longest_common(list(a), list(b)) == naive_lcs(a, b)


def test_metrics_of_small_texts(spark):
    one = metrics.text_metrics("the cat sat. the dog ran home!")
    assert one["sentence_length"] == 3.5 and one["sentence_variability"] == round(0.5 / 3.50001, 4)
    assert one["word_entropy"] == round(-sum(c / 7 * math.log2(c / 7) for c in Counter("the cat sat. the dog ran home!".split()).values()), 4)
    assert set(metrics.text_metrics("").values()) == {0.0}
    same = metrics.pair_metrics("a b c d e.", "a b c d e.")
    assert same["bleu"] == same["rouge_1"] == same["rouge_l"] == same["jaccard"] == 1.0 and same["edit_distance"] == 0.0
    assert set(metrics.pair_metrics("", "").values()) == {0.0}
    got = metrics.pair_metrics("the cat sat on the mat", "the cat is on the mat")
    assert (got["rouge_1"], got["rouge_2"], got["rouge_3"], got["rouge_l"]) == (round(5 / 6, 4), 0.6, 0.25, round(5 / 6, 4))
    assert got["bleu"] == round((5 / 6 * 3 / 5 * 1 / 4 * 0.1 / 3) ** 0.25, 4)
    assert metrics.pair_metrics("a b a b a b", "a b a b")["bigram_multiset"] == round(3 / 2, 4)
    d = spark.createDataFrame([(1, None), (1, "x y"), (None, "x y")], "id long, text string")
    assert metrics.measured(d, "id", metrics.text_metrics, "text").count() == 3


def test_levenshtein_of_columns(spark):
    r = random.Random(2)
    pairs = [tuple("".join(r.choice("abé日") for _ in range(r.randrange(0, 300))) for _ in "ab") for _ in range(20)] + [("", ""), ("", "x")]
    out = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(math.isclose(x["d"], naive_edit(x["a"], x["b"]) / max(len(x["a"]), len(x["b"]), 1)) for x in out)


def test_labels(spark):
    d = spark.createDataFrame([("Human",), (" AI ",), ("0.7",), ("true",), ("2",), ("1",), (None,)], "x string")
    assert [r[0] for r in d.select(T.normalize_label(F.col("x"))).collect()] == [0, 1, None, None, None, 1, None]
    n = spark.createDataFrame([(0.7,), (1.0,), (2.0,), (None,)], "x double")
    assert [r[0] for r in n.select(T.normalize_label(F.col("x"), "number")).collect()] == [0, 1, None, None]
    t = spark.createDataFrame([(None, "Story"), (None, "x"), ("human", "x"), (None, None)], "y string, kind string")
    assert [r[0] for r in t.select(T.infer_label([F.col("y")], [F.col("kind")])).collect()] == [0, 1, 0, 1]


def test_text_functions(spark):
    one = lambda e, v: spark.createDataFrame([(v,)], "x string").select(e(F.col("x"))).first()[0]
    assert one(T.without_emphasis, "a **b** __c__ *d* e***f") == "a b c d e f"
    assert one(T.tidy_space, " a\t\t b\n\n\n\nc \n") == "a b\n\nc"
    assert one(T.plain_quotes, "“a” ‘b’ `c´") == "\"a\" 'b' 'c'"
    assert one(T.without_reference_numbers, "x [12]. y [3-4] z") == "x y z"
    assert one(T.is_refusal, "Sorry, I am unable to do it") and not one(T.is_refusal, "I can")
    assert one(T.sentences, "A b. C d!  E? ") == ["A b.", "C d!", "E? "] or one(T.sentences, "A b. C d!  E? ") == ["A b.", "C d!", "E?"]
    keys = sorted(["f10", "f9", "f2a10", "f2a9"], key=lambda n: one(T.natural_key, n))
    assert keys == ["f2a9", "f2a10", "f9", "f10"]
    zeros = "0" * 24
    keys = [one(T.natural_key, n) for n in (f"f1{zeros}", f"f2{zeros}", f"f1{zeros}0", "f007", "f7", "f0")]
    assert keys[0] < keys[1] < keys[2] and keys[3] == keys[4] > keys[5]
    assert [tuple(one(T.parse_option, o)) for o in ("block_shuffle_0.5", "none", "a_b")] == [("block_shuffle", 0.5), ("none", 0.0), ("a", 0.0)]
    assert one(T.normalize, "  A B\tC\x1cd ") == "a b c d" and one(lambda c: T.normalize(c, True), "a, b! ²_") == "a b ²_"


def test_zero_vectors_and_equal_lengths_do_not_raise(spark):
    d = spark.createDataFrame([([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert d.select(T.cosine(F.col("a"), F.col("b"))).first()[0] is None


def test_histogram_of_equal_lengths(spark, tmp_path):
    spark.createDataFrame([(1, "abc"), (2, "xyz")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in catalogue.queries()["histogram"](spark, str(tmp_path)).collect()] == [(0, 2)]


def test_containment_of_short_passages(spark, tmp_path):
    docs = [(1, "we saw one two three four five. Then"), (2, "xone twoz"), (3, "nothing"), (4, None), (5, "")]
    items = [(1, "one two three four five"), (2, "one two"), (3, "hin"), (4, "ne"), (5, ""), (6, None), (7, "saw one two"), (8, "e")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, catalogue.queries()["benchmark_containment"](spark, str(tmp_path)).collect()))
    assert got == sorted((i, d) for i, p in items if p for d, t in docs if t and p in t)


def test_dedup_reasons_and_counters(spark):
    df = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    test, train = df([(1, "Same text")]), df([(2, "same  TEXT"), (3, "same text"), (4, "other"), (5, "other"), (6, "near"), (7, None)])
    reasons = dedup.removal_reasons(dedup.hashed(test, "doc_id", "text"), dedup.hashed(train, "doc_id", "text"), df([(6, "")]), "doc_id")
    assert dict(map(tuple, reasons.collect())) == {2: "exact", 3: "internal_dup", 4: "kept", 5: "internal_dup", 6: "near", 7: "kept"}
    assert tuple(dedup.removal_counters(reasons).first()) == (6, 2, 1, 1, 2)


def test_simhash_of_odd_texts(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (4, "a b"), (5, "A  b"), (6, "a b c d")], "doc_id long, text string")
    out = {r["doc_id"]: r["simhash"] for r in neardup.simhash64(d, "doc_id", "text").collect()}
    assert out[1] == out[2] == 0 and out[4] == out[5] and len({out[3], out[4], out[6]}) == 3


def test_orders_of_perturbation(spark):
    for n in (0, 1, 2, 3, 7, 40):
        for s in (0.0, 0.3, 0.5, 1.0, 2.0):
            for f in (perturb.global_order, perturb.block_order):
                assert sorted(f(n, s)) == list(range(n)) and f(n, s) == f(n, s)
    d = spark.createDataFrame([(1, list("abcdefg")), (2, []), (3, None)], "id long, s array<string>")
    out = {r["id"]: r["s"] for r in perturb.reordered(d, "s", perturb.block_order, 0.5).collect()}
    assert out[1] == [list("abcdefg")[i] for i in perturb.block_order(7, 0.5)] and out[2] == [] and out[3] is None


def test_evaluation_without_rows_or_with_one_class(spark):
    none = spark.createDataFrame([], "label int, prob double")
    assert tuple(evaluation.scores_at(none).first()) == (0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0)
    assert tuple(evaluation.best_f1(none).first()) == (0.5, -1.0)
    one = spark.createDataFrame([(1, 0.2), (1, 0.9)], "label int, prob double")
    assert evaluation.auc(one).first()[0] == 0.0 and tuple(evaluation.best_f1(one).first()) == (0.2, round(2 / 3, 6))
    assert evaluation.temperature(one, 0).first()["calibrated"] == pytest.approx(0.2)


def test_ranks_by_slices(spark):
    d = spark.createDataFrame([(i, i % 2 if i % 7 else None) for i in range(300)], "id long, y int")
    out = sequences.ranked(d, "y", "id", "1").collect()
    for y in (0, 1, None):
        assert sorted(r["rk"] for r in out if r["y"] == y) == list(range(1, sum(r["y"] == y for r in out) + 1))
    assert {r["cnt"] for r in out if r["y"] is None} == {sum(r["y"] is None for r in out)}


def test_json_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.jsonl").write_text('{"text": "one"}\n\n{broken\n{"text": null}\n')
    assert sorted(r["text"] or "" for r in files.read_jsonl(spark, str(tmp_path / "a"), "text string").collect()) == ["", "one"]
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, str(tmp_path / "a"), "text string", strict=True).collect()
    (tmp_path / "w.json").write_text('[\n {"text": "p"},\n {"text": "q"}]')
    back = files.read_json(spark, str(tmp_path / "w.json"), "text string")
    files.write_jsonl(back, str(tmp_path / "out"))
    assert sorted(r["text"] for r in files.read_jsonl(spark, str(tmp_path / "out"), "text string").collect()) == ["p", "q"]
