import http.server
import json
import math
import threading

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import building as B
from corpusmill.operators import cleaning, dedup, evaluation, neardup, sequences
from corpusmill.sources import download, files


def records(spark, items):
    return spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(items)], "i int, j string").select("i", F.parse_json("j").alias("record"))


def test_resolvers(spark):
    items = [{"text": "t", "abstract": "a"}, {"text": "", "abstract": "a"}, {"abstract": None, "text": None, "content": ""}, {"text": 5, "content": "c"}, {"content": {"x": [1]}}, {}, [1], "s", None]
    got = records(spark, items).select("i", B.text_or_abstract(F.col("record")).alias("x"), B.abstract_or_text(F.col("record")).alias("y"), B.any_text(F.col("record")).alias("z")).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [("t", "a", "t"), ("a", "a", ""), ("", "", ""), ("", "", "5"), ("", "", '{"x":[1]}'), ("", "", ""), ("", "", ""), ("", "", ""), ("", "", "")]


def test_labels_of_every_type(spark):
    cases = {True: 1, False: 0, 0: 0, 1: 1, 2: None, -1: None, 0.7: 0, -0.3: 0, 1.9: 1, 1e300: None, " Human ": 0, "AI": 1, "human_written": 0, "maybe": None, "1": 1, "": None}
    items = [{"label": k} for k in cases] + [{"label": None}, {}, {"label": [1]}]
    got = records(spark, items).select("i", B.label_of(B.field(F.col("record"), "label")).alias("y")).orderBy("i").collect()
    # 0, 1 and booleans are equal as keys, so the last value of each stands for both.
    assert [r["y"] for r in got] == [*cases.values(), None, None, None]


def test_human_predicate_and_inferred_labels(spark):
    items = [{"label": 0, "data_type": "news"}, {"label": "ai", "type": "story"}, {"label": "?", "type": " Story"}, {"data_type": "", "type": "content"}, {"data_type": "news", "type": "content"}, {"data_type": 5, "type": "content"}, {"gold": "x", "class": 0}, {"category": "ABSTRACT"}, {}]
    got = records(spark, items).select("i", B.is_human(F.col("record")).alias("h"), B.inferred_label(F.col("record")).alias("y")).orderBy("i").collect()
    assert [(r["h"], r["y"]) for r in got] == [(True, 0), (False, 1), (True, 0), (True, 0), (False, 0), (False, 0), (False, 0), (False, 0), (False, 1)]


def test_rows_of_a_test_set_and_their_counters(spark):
    items = [{"text": "a", "label": 1}, {"text": "", "label": None}, {"text": "b"}, "plain", 7, None, {"label": "x", "type": "story"}]
    rows = B.test_rows(records(spark, items).withColumn("file", F.lit("f"))).orderBy("i")
    assert [(r["text"], r["label"], r["empty_text"], r["missing_label"]) for r in rows.collect()] == [("a", 1, False, False), ("", 1, True, False), ("b", 1, False, True), ("plain", 1, False, True), ("7", 1, False, True), ("", 1, False, True), ("", 0, True, False)]
    assert B.test_row_counters(rows, "file").first()[:] == ("f", 7, 2, 4)
    assert B.filled(rows).count() == 4 and B.complete(rows, "text", "label").count() == 7
    assert B.test_rows(records(spark, [])).collect() == []


@pytest.fixture
def server():
    seen = {}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            seen[self.path] = seen.get(self.path, 0) + 1
            if self.path == "/gone" or self.path == "/late" and seen[self.path] < 3:
                self.send_error(503)
                return
            body = b"x" * (5 if self.path == "/cut" else 3_000_000 if self.path == "/big" else 10)
            self.send_response(200)
            self.send_header("Content-Length", str(len(body) + (5 if self.path == "/cut" else 0)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", seen
    s.shutdown()


def test_download_is_whole_or_not_at_all_and_runs_again(spark, server, tmp_path):
    url, seen = server
    folder = tmp_path / "data"
    names = ["small", "big", "late", "gone", "cut"]
    (folder / "a").mkdir(parents=True)
    (folder / "there").write_bytes(b"kept")
    (folder / "small").write_bytes(b"")
    df = spark.createDataFrame([(n if n != "big" else "a/big", f"{url}/{n}") for n in [*names, "there"]], "name string, url string")
    got = {r["name"]: r[2:] for r in download.download(df, f"file://{folder}", attempts=3, pause=0.01).collect()}
    assert got == {"small": ("fetched", 10, 1), "a/big": ("fetched", 3_000_000, 1), "late": ("fetched", 10, 3), "gone": ("failed", 0, 3), "cut": ("failed", 0, 3), "there": ("there", 4, 0)}
    assert sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file()) == ["a/big", "late", "small", "there"] and "/there" not in seen
    assert {r["state"]: (r["files"], r["n_bytes"]) for r in download.outcome(download.download(df, f"file://{folder}", attempts=1)).collect()} == {"there": (4, 3_000_024), "failed": (2, 0)}


def test_back_off_grows_with_the_attempt(tmp_path):
    waits = []
    assert download.fetched("http://127.0.0.1:9/x", f"file://{tmp_path}", "x", 4, 5.0, sleep=waits.append)[0] == "failed" and waits == [5.0, 10.0, 15.0]


def test_training_logs_and_settings(spark, tmp_path):
    for name, log in (("checkpoint-900", [{"epoch": 1.0, "step": 5, "loss": 0.5}]), ("checkpoint-99", [{"epoch": 0.5, "step": 1, "loss": 2.0}, {"epoch": 1.0, "step": 2}, {"step": 3, "loss": 1.0}, {"epoch": 2.0, "step": 4, "loss": 1.5, "lr": 1}])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "trainer_state.json").write_text(json.dumps({"best": None, "log_history": log}))
    assert [r[:] for r in files.read_training_log(spark, f"file://{tmp_path}").orderBy("step").collect()] == [(0.5, 1, 2.0), (2.0, 4, 1.5)]
    (tmp_path / "checkpoint-x").mkdir()
    assert files.read_training_log(spark, f"file://{tmp_path}").collect() == [] == files.read_training_log(spark, f"file://{tmp_path}/none").collect()
    (tmp_path / "t.json").write_text('{"threshold": 0.37, "word": "x"}')
    (tmp_path / "bad.json").write_text("{")
    read = lambda f, n, d: files.read_setting(spark, f"file://{tmp_path}/{f}", n, d).first()[0]
    assert [read("t.json", "threshold", 0.5), read("t.json", "word", 1.0), read("bad.json", "threshold", 0.5), read("no.json", "temperature", 1.0)] == [0.37, 1.0, 0.5, 1.0]


def test_figures(spark):
    m = spark.createDataFrame([("BLEU", "a", 1.0), ("BLEU", "a", 3.0), ("BLEU", "b", 5.0), ("METEOR", "b", 7.0)], "metric string, model string, value double")
    got = {r["metric"]: (r["a"], r["b"], r["c"]) for r in evaluation.mean_table(m, ["a", "b", "c"]).collect()}
    assert got["BLEU"][:2] == (2.0, 5.0) and math.isnan(got["BLEU"][2]) and math.isnan(got["METEOR"][0]) and got["METEOR"][1] == 7.0
    v = spark.createDataFrame([(x,) for x in [1.0, 1.9, 2.0, -0.5, None, float("nan"), float("inf")]], "v double")
    assert sorted(r[:] for r in evaluation.whole_bins(v, "v").collect()) == [(-1, 1, 1.1), (1, 2, 1.1), (2, 1, 1.1)]
    assert sorted(r[0] for r in evaluation.without_outliers(v, "v").collect()) == [-0.5, 1.0, 1.9, 2.0]


def test_one_class_alone_fills_whole_batches(spark):
    d = spark.range(25).select("id", F.lit(1).alias("y"))
    sizes = sorted(r["n"] for r in sequences.balanced_batches(d, "y", "id", 5, "s").groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect())
    assert sizes == [5, 10, 10]


def test_texts_are_compared_within_their_set_alone(spark):
    text = "the same long text stands in both of the sets and is a copy of itself"
    rows = spark.createDataFrame([(1, text, "a"), (2, text, "b"), (3, text + "!", "b"), (4, text, None), (5, text, "b")], "doc_id long, text string, source string")
    test, train = rows.where("doc_id in (1, 5)"), rows.where("doc_id not in (1, 5)")
    pairs = neardup.near_classes(test, train, "doc_id", "text", within="source").select("test_id", "train_id", "source").collect()
    assert [tuple(p) for p in pairs] == [(5, 2, "b")]  # not with 1, whose set is another; the SimHash of 3 shares no band
    assert {r["source"]: tuple(r)[1:] for r in dedup.removal_by(test, train, "source", "doc_id", "text").collect()} == {"b": (2, 0, 1, 0, 1)}
    got = {r["source"]: (r["train_n"], r["test_n"], r["exact_overlap_light"], r["exact_overlap_strict"], r["near_ge_90_pairs"]) for r in dedup.leakage_by(test, train, "source", "doc_id", "text").collect()}
    assert got == {"a": (0, 1, 0, 0, 0), "b": (2, 1, 1, 1, 1)}


def test_cleaning_counts_by_file(spark):
    good = "This is a fine sentence about the weather in the mountains, and it goes on for long enough to be kept by every rule there is. " * 3
    rows = spark.createDataFrame([("a", good), ("a", "no"), ("b", "As an AI language model I cannot do it"), ("b", None)], "file string, text string")
    whole = cleaning.clean_counters(rows, "text").first()
    got = {r["file"]: (r["before"], r["kept"], r["dropped"]) for r in cleaning.clean_counters(rows, "text", by=("file",)).collect()}
    assert got["a"][0] == got["b"][0] == 2 and sum(g[1] for g in got.values()) == whole["kept"] and sum(g[2] for g in got.values()) == whole["dropped"] and got["b"][2] >= 1


def test_dealt_strategies_are_a_deck_for_each_bucket(spark):
    d = spark.range(70).select((F.col("id") % 2).alias("g"), F.floor(F.col("id") / 2).alias("chunk"))
    got = {}
    for r in sequences.dealt(d, "g", "chunk", sequences.DECK_2).orderBy("g", "chunk").collect():
        got.setdefault((r["g"], r["bucket"]), []).append(r["strategy"])
    assert len(got) == 6 and all(sorted(v) == sorted(sequences.DECK_2) for v in got.values()) and len({tuple(v) for v in got.values()}) > 2
    with pytest.raises(ValueError):
        sequences.dealt(d.where("chunk < 9"), "g", "chunk")
    assert sequences.dealt(d.where("chunk < 9"), "g", "chunk", strict=False).count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"\nc'), (2, None)], "i int, t string")
    files.write_csv(df.coalesce(1), f"file://{tmp_path}/csv")
    import csv

    (part,) = (tmp_path / "csv").glob("part-*.csv")
    assert list(csv.reader(part.open(newline=""), escapechar="\\", doublequote=False)) == [["i", "t"], ["1", 'a,"b"\nc'], ["2", ""]]
    for mode in ("errorifexists", "append"):
        files.write_jsonl(df, f"file://{tmp_path}/lines", mode)
    assert files.read_jsonl(spark, f"file://{tmp_path}/lines", "i int, t string").count() == 4
