import itertools
import json
import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import metrics, rewrite
from corpusmill.functions import stemming as St
from corpusmill.operators import dedup, evaluation, neardup, perturb, policy, routes, scorers, sequences, vectors
from corpusmill.plans import catalogue

SF = "/root/testdata/sf0.001"

# Pairs that the published description of the algorithm gives, and some of its later departures.
STEMS = """caresses caress|ponies poni|ties tie|caress caress|cats cat|feed feed|agreed agre|plastered plaster|bled bled|motoring motor|sing sing|conflated conflat|troubled troubl|sized size|hopping hop|tanned tan|falling fall|hissing hiss|fizzed fizz|failing fail|filing file|happy happi|sky sky|relational relat|conditional condit|rational ration|valenci valenc|hesitanci hesit|digitizer digit|conformabli conform|radicalli radic|differentli differ|vileli vile|analogousli analog|vietnamization vietnam|predication predic|operator oper|feudalism feudal|decisiveness decis|hopefulness hope|callousness callous|formaliti formal|sensitiviti sensit|sensibiliti sensibl|triplicate triplic|formative form|formalize formal|electriciti electr|electrical electr|hopeful hope|goodness good|revival reviv|allowance allow|inference infer|airliner airlin|gyroscopic gyroscop|adjustable adjust|defensible defens|irritant irrit|replacement replac|adjustment adjust|dependent depend|adoption adopt|homologou homolog|communism commun|activate activ|angulariti angular|homologous homolog|effective effect|bowdlerize bowdler|probate probat|rate rate|cease ceas|controll control|roll roll|died die|dies die|flies fli|dying die|news news|enjoy enjoy|by by|say say|as as"""


def test_stems():
    for pair in STEMS.split("|"):
        word, want = pair.split()
        assert St.stem(word) == want, word


def brute_meteor(pred, ref):
    """One word at a time from the end, as the greedy alignment is defined."""
    a, b, pairs = list(enumerate(w.lower() for w in pred)), list(enumerate(w.lower() for w in ref)), []
    for form in (str, St.stem):
        for i in range(len(a))[::-1]:
            for j in range(len(b))[::-1]:
                if form(a[i][1]) == form(b[j][1]):
                    pairs.append((a.pop(i)[0], b.pop(j)[0]))
                    break
    if not pairs:
        return 0.0
    pairs.sort()
    chunks = 1 + sum(not (q[0] == p[0] + 1 and q[1] == p[1] + 1) for p, q in itertools.pairwise(pairs))
    p, r = len(pairs) / len(pred), len(pairs) / len(ref)
    return p * r / (0.9 * p + 0.1 * r) * (1 - 0.5 * (chunks / len(pairs)) ** 3)


def test_meteor_against_brute_force():
    r = random.Random(2)
    words = ["cat", "cats", "Run", "running", "runs", "a", "on", "happy", "happily"]
    for _ in range(500):
        p, q = ([r.choice(words) for _ in range(r.randrange(0, 8))] for _ in range(2))
        assert math.isclose(St.meteor(p, q), brute_meteor(p, q), abs_tol=1e-12)
    assert St.meteor(["car"], ["auto"]) == 0.0 and St.meteor(["car"], ["auto"], lambda w: {"car": 1, "auto": 1}.get(w, w)) == 0.5


def test_pair_metrics_gain_stems_and_meteor():
    m = metrics.pair_metrics("the cats were running", "The cat was running fast")
    assert m["rouge_1"] == round(2 * 2 / 9, 4) and m["rouge_1_stemmed"] == round(2 * 3 / 9, 4) and m["rouge_l_stemmed"] == m["rouge_1_stemmed"]
    assert m["meteor"] == round(brute_meteor("the cats were running".split(), "The cat was running fast".split()), 4)
    assert metrics.pair_metrics("", "a")["meteor"] == 0.0


def test_pooling_against_numpy(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), [r.random() for _ in range(3)], r.choice([800.0, 1.0, -900.0, 0.5]), r.choice([1, 1, 0, None])) for _ in range(60)]
    rows += [("masked", [1.0, 2.0, 3.0], 5.0, 0), ("masked", [3.0, 2.0, 1.0], -5.0, 0), ("a", None, 1.0, 1), ("a", [9.0] * 3, None, 1), ("none", None, 1.0, 1)]
    df = spark.createDataFrame(rows, "g string, x array<double>, s double, m int")
    got = {x["g"]: x["x"] for x in vectors.attention_pool(df, ["g"], "x", "s", "m").collect()}
    assert got.keys() == {"a", "b", None, "masked"}
    for g, v in got.items():
        own = [(x, s if m else vectors.MASKED) for h, x, s, m in rows if h == g and x is not None and s is not None]
        s = np.array([y for _, y in own])
        w = np.exp(s - s.max())
        assert np.allclose(v, (w / w.sum()) @ np.array([x for x, _ in own]))
    assert got["masked"] == [2.0, 2.0, 2.0]
    assert vectors.attention_pool(df.limit(0), ["g"], "x", "s").collect() == []


def test_mixing_of_options_depends_on_seed_and_temperature(spark):
    df = spark.createDataFrame([(1, k, [float(k == i) for i in range(4)], float(k)) for k in range(4)], "g int, k int, x array<double>, l double")
    mix = lambda **a: vectors.option_mix(df, ["g"], "k", "x", "l", **a).first()["x"]
    e = np.exp(np.arange(4) / 0.5)
    assert np.allclose(mix(tau=0.5), e / e.sum()) and mix(seed=1) == mix(seed=1) != mix(seed=2) and np.isclose(sum(mix(seed=1)), 1)
    assert df.select(vectors.blended(F.col("x"), [F.col("x"), F.array(*[F.lit(2.0)] * 4)], 0.5)).first()[0] == [0.5 + 0.5 * 1.5, 0.5, 0.5, 0.5]
    best = spark.createDataFrame([([1.0, 3.0, 3.0],), ([],), ([2.0],)], "v array<double>").select(vectors.first_best(F.col("v"))).collect()
    assert [b[0] for b in best] == [1, None, 0]


def test_policy_measures_before_each_layer_and_takes_the_first_best(spark):
    nets = policy.load(policy.seeded_weights(spark, 7))
    assert {k: (n.w1.shape, n.b1.shape, n.w2.shape, n.b2.shape) for k, n in nets.items()} == {k: ((64, 5), (64,), (len(o), 64), (len(o),)) for k, o in rewrite.LAYERS.items()}
    assert all(np.abs(n.w1).max() <= 1 / math.sqrt(5) and np.abs(n.w2).max() <= 1 / 8 for n in nets.values())
    flat = policy.Network(np.zeros((64, 5)), np.zeros(64), np.zeros((7, 64)), np.array([0, 1, 1, 0, 1, 0, 0.0]))
    assert flat.choice([1.0] * 5) == 1
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(40).collect()} | {-1: None, -2: ""}
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    got = {r["id"]: (r["reordered"], r["perturbed"]) for r in policy.perturbed(df, "id", "text", policy.seeded_weights(spark, 7)).collect()}
    chosen = set()
    for i, t in texts.items():
        s, first = perturb.split(t or ""), None
        for layer, options in rewrite.LAYERS.items():
            f = policy.layer_features(layer, " ".join(s))
            n = nets[layer]
            hidden = [max(0.0, sum(w * x for w, x in zip(row, f)) + b) for row, b in zip(n.w1.tolist(), n.b1.tolist())]
            logits = [sum(w * x for w, x in zip(row, hidden)) + b for row, b in zip(n.w2.tolist(), n.b2.tolist())]
            option = options[logits.index(max(logits))]
            chosen.add(option)
            s = perturb.applied(s, option)
            first = " ".join(s) if layer == "O" else first
        assert got[i] == (first, " ".join(s))
    assert len(chosen) > 3


@pytest.mark.parametrize("mode, delta", [("max", 0.0), ("max", 0.3), ("min", 0.3)])
def test_early_stopping_of_many_runs_against_a_loop(spark, mode, delta):
    r = random.Random(5)
    rows = [(run, e, None if r.random() < 0.1 else r.random()) for run in (None, 1, 2, 3) for e in range(r.randrange(1, 300))]
    want, state = {}, {}
    for run, e, v in rows:
        if v is None:
            continue
        best, bad = state.get(run, (None, 0))
        better = best is None or (v > best + delta if mode == "max" else v < best - delta)
        state[run] = (v, 0) if better else (best, bad + 1)
        want[run, e] = (state[run][0], better, not better and state[run][1] >= 4)
    d = spark.createDataFrame(rows, "run int, epoch int, v double").repartition(7)
    got = sequences.early_stopping_runs(d, "run", "epoch", "v", 4, mode, delta).collect()
    assert {(x["run"], x["epoch"]): (x["best"], x["better"], x["stop"]) for x in got} == want and len(got) == len(want)


def test_examples_are_the_smallest_and_bounded(spark):
    texts = [f"the quick brown fox number {i // 30} jumps over the lazy dog again and again" for i in range(120)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    test, train = rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1")
    pairs = neardup.near_pairs(test, train, "doc_id", "text").where("score >= 0.9").orderBy("test_id", "train_id").limit(20).collect()
    got = neardup.near_examples(test, train, "doc_id", "text").collect()
    assert [(r["test_id"], r["train_id"]) for r in got] == [(r["test_id"], r["train_id"]) for r in pairs] and len(got) == 20
    h = [dedup.hashed(x, "doc_id", "text") for x in (test, train)]
    assert [r["h"] for r in dedup.overlap_examples(*h, n=3).collect()] == sorted({r["h"] for r in h[0].collect()})[:3]


def test_seeded_sets_are_the_same_rows_in_other_orders(spark, tmp_path):
    d = spark.range(200).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"))
    s = sequences.seeded_sets(d, "y", "id", total=100, ratio=0.4)
    sets = {}
    for r in s.orderBy("position").collect():
        sets.setdefault((r["split"], r["seed"]), []).append(r["id"])
    train = [sets["train", k] for k in ("11", "22", "33")]
    assert len(sets) == 4 and len(sets["test", "202401"]) == 40 and all(len(t) == 60 and set(t) == set(train[0]) for t in train)
    assert len({tuple(t) for t in train}) == 3 and not set(train[0]) & set(sets["test", "202401"])
    assert [r[:] for r in s.orderBy("split", "seed", "position").collect()] == [r[:] for r in sequences.seeded_sets(d.repartition(9), "y", "id", total=100, ratio=0.4).orderBy("split", "seed", "position").collect()]
    sequences.write_in_order(s.where("seed = '22'").repartition(5), f"file://{tmp_path}/out", "position", files=4)
    files = sorted(Path(tmp_path, "out").glob("part-*.json"))
    assert [json.loads(x)["id"] for f in files for x in f.read_text().splitlines()] == sets["train", "22"] and len(files) == 4


def test_policy_query_is_registered():
    assert "policy_perturbation" in catalogue.queries()


def test_scores_in_slices_agree_with_plain_counts(spark):
    r = random.Random(21)
    rows = [(r.randrange(2), r.choice([r.random(), 0.5, 1.0, 0.0, r.random() * 3 - 1])) for _ in range(700)]
    d = spark.createDataFrame(rows, "label int, prob double")
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert evaluation.auc(d).first()[0] == round(want, 6)
    got = {x["threshold"]: (x["tpr"], x["fpr"]) for x in evaluation.roc_points(d).collect()}
    assert got == {t: (round(sum(p >= t for p in pos) / len(pos), 6), round(sum(p >= t for p in neg) / len(neg), 6)) for t in {p for _, p in rows}}
    plan = evaluation.roc_points(d)._jdf.queryExecution().analyzed().toString()
    assert "windowspecdefinition(prob" not in plan


@pytest.mark.parametrize("depth", [1, 3])
def test_joint_classifier_against_plain_loops(spark, depth):
    r = random.Random(31)
    width, hidden, fusion = 5, 4, 6
    table = {(x["step"], x["row"], x["col"]): x["value"] for x in routes.seeded_weights(spark, width, hidden, fusion, depth, 9).collect()}
    assert len({k[0] for k in table}) == 4 * depth + 1

    def step(name, x):
        out = []
        for o in range(1 + max(k[1] for k in table if k[0] == name)):
            y = sum(table[name, o, i] * v for i, v in enumerate(x)) + table[name, o, -1]
            if depth > 1 and name != "out/0":
                mean, var, scale, shift = (table[name, o, -k] for k in (2, 3, 4, 5))
                y = (y - mean) / math.sqrt(var + 1e-5) * scale + shift
            out.append(y)
        return out

    def stack(name, x):
        first = out = [max(0.0, y) for y in step(f"{name}/0", x)]
        for k in range(1, depth):
            out = [max(0.0, y) for y in step(f"{name}/{k}", out)]
        return [a + b for a, b in zip(out, first)] if depth > 1 else out

    rows = [(i, *[[r.uniform(-1, 1) for _ in range(n)] for _ in range(3) for n in (3, 2)]) for i in range(30)] + [(99, None, *[[0.0] * n for n in (2, 3, 2, 3, 2)])]
    names = [f"{a}_{b}" for a in routes.ROUTES for b in ("vector", "metrics")]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{n} array<double>" for n in names))
    got = {x["id"]: (x["prob"], x["pred"]) for x in routes.classified(df, "id", routes.load(routes.seeded_weights(spark, width, hidden, fusion, depth, 9), depth)).collect()}
    assert got.pop(99) == (None, None)
    for i, *v in rows[:-1]:
        fused = [y for k, name in enumerate(routes.ROUTES) for y in stack(name, v[2 * k] + v[2 * k + 1])]
        p = 1 / (1 + math.exp(-step("out/0", stack("fusion", fused))[0]))
        assert math.isclose(got[i][0], p, rel_tol=1e-9) and got[i][1] == int(p > 0.5)


def test_models_load_once_in_a_worker_and_failures_get_a_value(spark):
    def load():
        import os

        calls = []

        def model(texts):
            calls.append(len(texts))
            if any("bad" in t for t in texts):
                raise RuntimeError("no")
            return [[float(len(t)), float(os.getpid()), float(len(calls))] for t in texts]

        return model

    texts = [None, "", "abc", "bad one", *["x" * i for i in range(60)]]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").coalesce(1)
    twice = [{r["id"]: r["v"] for r in scorers.modelled(df, "t", "v", "toy", load, "array<double>", 8, [0.0, 0.0, 0.0]).collect()} for _ in range(2)]
    for got in twice:
        assert got[3] == [0.0, 0.0, 0.0] and all(got[i][0] == len(t or "") for i, t in enumerate(texts) if i != 3)
    # The same worker goes on counting calls where it runs both times.
    same = twice[0][5][1] == twice[1][5][1]
    assert not same or twice[1][5][2] > twice[0][5][2]
    both = scorers.by_models(df, "t", "out", {"up": lambda: lambda ts: [t.upper() for t in ts], "cut": lambda: lambda ts: [t[1] for t in ts]}, failed="").collect()
    assert len(both) == 2 * len(texts) and {r["out"] for r in both if r["id"] == 2} == {"ABC", "b"} and [r["out"] for r in both if r["id"] == 1] == ["", ""]


def test_levels_and_pair_reports(spark):
    d = spark.createDataFrame([(1, 2.0, 3.0, 4.0)], "id int, PPL double, SyntacticErrors double, AvgSentenceLength double")
    assert evaluation.by_level(d, "id").first().asDict(True) == {"id": 1, "L1": {"AvgSentenceLength": 4.0}, "L3": {"SyntacticErrors": 3.0}, "L4": {"PPL": 2.0}}
    r = metrics.pair_report("a b. c", "a b")
    assert r["bleu"] == metrics.pair_metrics("a b. c", "a b")["bleu"] and r["prediction_sentence_length"] == 1.5 and r["reference_sentence_length"] == 2.0


def test_character_grams(spark):
    cases = {"": [], "abc": ["abc"], "abcde": ["abcde"], "éaéaéaé": ["aéaéa", "éaéaé"], "a\U0001f600bcdef": ["a\U0001f600bcd", "bcdef", "\U0001f600bcde"], None: []}
    got = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string").select("i", F.array_sort(neardup.char_grams(F.col("t"))).alias("g")).collect()
    assert {r["i"]: r["g"] for r in got} == {i: sorted(g, key=lambda x: x.encode()) for i, g in enumerate(cases.values())}


def test_distances_are_the_same_from_either_side():
    long, short = "abcde" * 200, "bd" * 3
    assert metrics.edit_distance(short, long) == metrics.edit_distance(long, short) == 994
    assert metrics.longest_common(list(short), list(long)) == metrics.longest_common(list(long), list(short)) == 6


def test_shared_n_grams_are_those_of_counters():
    r = random.Random(4)
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(0, 20))] for _ in range(2))
        for n in (1, 2, 3, 4):
            x, y = metrics.grams(a, n), metrics.grams(b, n)
            assert metrics.shared_grams(a, b, n) == sum((x & y).values()) and metrics.n_grams(a, n) == sum(x.values())
    assert metrics.edit_distance("abc" * 99, "abc" * 99) == 0 and metrics.edit_distance("", "") == 0


def test_pair_metrics_run_where_the_package_is_not_installed(tmp_path):
    import os
    import subprocess
    import sys

    from pyspark import cloudpickle

    sent = cloudpickle.dumps(metrics.pair_metrics)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", "import pickle, sys; print(pickle.load(sys.stdin.buffer)('the cats were running', 'The cat was running fast'))"], input=sent, capture_output=True, cwd=tmp_path, env=env)
    assert got.returncode == 0, got.stderr.decode()[-300:]
    assert str(metrics.pair_metrics("the cats were running", "The cat was running fast")) in got.stdout.decode()
