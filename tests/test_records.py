import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusmill.sources import records as R


def put(base, files):
    for name, text in files.items():
        p = base / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text, encoding="utf-8")


FILES = {
    "a.json": '[{"text": "é", "label": 1}, {"text": null}, 5]',
    "b/c d.json": '{"name": "n", "data": [{"text": "x", "label": {"m": {"k": ["t"]}}}], "v": [1, {"z": 2}]}',
    "b/one.JSON": '{"data": 3, "text": "only"}',
    "b/e+%.jsonl": '{"a": 1}\n\n{bad\n{"a": "é\\n"}\n',
    "empty.json": "[]",
    "wrapped.json": '{"data": []}',
    "bad.json": '{"a": ',
    "number.json": "5",
    "blank.jsonl": "\n\n",
    "other.txt": "no",
}


def test_wrappers_records_and_formats(spark, tmp_path):
    put(tmp_path / "in", FILES)
    recs, env = R.read_records(spark, f"file://{tmp_path}/in")
    got = {}
    for r in recs.select("file", "ord", F.to_json("record").alias("j")).orderBy("file", "ord").collect():
        got.setdefault(r["file"], []).append(json.loads(r["j"]))
    assert got == {"a.json": [{"text": "é", "label": 1}, {"text": None}, 5], "b/c d.json": [{"text": "x", "label": {"m": {"k": ["t"]}}}], "b/one.JSON": [{"data": 3, "text": "only"}], "b/e+%.jsonl": [{"a": 1}, {"a": "é\n"}]}
    kinds = {r["file"]: (r["wrapper"], r["envelope"] and json.loads(r["envelope"])) for r in env.collect()}
    assert kinds == {"a.json": ("list", None), "b/c d.json": ("data", {"name": "n", "v": [1, {"z": 2}]}), "b/one.JSON": ("single", None), "b/e+%.jsonl": ("lines", None), "empty.json": ("list", None), "wrapped.json": ("data", {}), "bad.json": ("none", None), "number.json": ("none", None), "blank.jsonl": ("lines", None)}
    assert {r["file"]: r["format"] for r in R.file_formats(recs).collect()} == {"a.json": "flat", "b/c d.json": "nested", "b/one.JSON": "other", "b/e+%.jsonl": "other"}
    assert {r["file"] for r in R.scan_files(spark, f"file://{tmp_path}/in").collect()} == FILES.keys() - {"other.txt"}


def test_round_trip_gives_each_file_back_in_its_wrapper(spark, tmp_path):
    put(tmp_path / "in", FILES)
    recs, env = R.read_records(spark, f"file://{tmp_path}/in")
    assert R.write_records(recs, env, f"file://{tmp_path}/out") == 9
    read = lambda n: (tmp_path / "out" / n).read_text(encoding="utf-8")
    for n in ("a.json", "b/c d.json", "b/one.JSON", "empty.json", "wrapped.json"):
        assert json.loads(read(n)) == json.loads(FILES[n])
    assert [json.loads(x) for x in read("b/e+%.jsonl").splitlines()] == [{"a": 1}, {"a": "é\n"}]
    assert json.loads(read("bad.json")) == json.loads(read("number.json")) == [] and read("blank.jsonl") == "\n"
    assert {str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file() and p.suffix != ".crc"} == FILES.keys() - {"other.txt"}
    assert R.same(R.diff_directories(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out"))
    assert not list(tmp_path.glob("out-*"))


def test_dropped_records_leave_the_wrapper(spark, tmp_path):
    put(tmp_path / "in", {k: FILES[k] for k in ("a.json", "b/c d.json", "b/one.JSON")})
    recs, env = R.read_records(spark, f"file://{tmp_path}/in")
    R.write_records(recs.where("file = 'a.json' and ord = 1"), env, f"file://{tmp_path}/out")
    read = lambda n: json.loads((tmp_path / "out" / n).read_text())
    assert (read("a.json"), read("b/c d.json"), read("b/one.JSON")) == ([{"text": None}], {"name": "n", "v": [1, {"z": 2}], "data": []}, [])


@pytest.mark.parametrize("most", [None, 0, 1, 7, 400, 10_000])
def test_line_limit_counts_bad_and_blank_lines_over_many_splits(spark, tmp_path, most):
    r = random.Random(4)
    files = {f"f{k}.jsonl": "\n".join(r.choice(["", "{bad", json.dumps({"i": i, "t": "é" * r.randrange(40)})]) for i in range(n)) + ("\n" if n % 2 else "") for k, n in enumerate((0, 1, 900, 2_001))}
    put(tmp_path, files)
    want = set()
    for name, text in files.items():
        for i, line in enumerate((tmp_path / name).open(encoding="utf-8")):
            if most is not None and i >= most:
                break
            if line.strip() and not line.startswith("{bad"):
                want.add((name, i, json.loads(line)["i"]))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = R.read_lines(spark, f"file://{tmp_path}", most)
        assert {(Path(x["file"]).name, x["ord"], x["i"]) for x in got.select("file", "ord", F.try_variant_get("record", "$.i", "long").alias("i")).collect()} == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_directory_diff_names_the_first_difference(spark, tmp_path):
    one = {"equal.json": '[{"a": 1, "b": 2}]', "gone.json": "[]", "count.jsonl": '{"a": 1}\n\n{"a": 2}\n', "field.json": '[{"a": 1}, {"a": 1, "b": [1, 2], "c": 0}, {"a": 9}]', "keys.json": '{"data": [{"a": 1}]}', "whole.json": "[1, 2]", "gap.jsonl": '{"a": 1}\n{"a": 2}\n', "type.json": '{"a": 1}', "none.json": "[]"}
    two = one | {"equal.json": '{"data": [{"b": 2, "a": 1}], "x": 1}', "count.jsonl": '{"a": 1}\n', "field.json": '[{"a": 1}, {"a": 1, "b": [1, 3], "c": 1}, {"a": 8}]', "keys.json": '[{"z": 1}]', "whole.json": "[1, 3]", "new.json": "[]", "gap.jsonl": '\n{"a": 1}\n\n{"a": 2}\n', "type.json": '["a"]', "none.json": "{bad"}
    two.pop("gone.json")
    put(tmp_path / "x", one)
    put(tmp_path / "y", two)
    d = R.diff_directories(spark, f"file://{tmp_path}/x", f"file://{tmp_path}/y")
    got = {r["file"]: (r["verdict"], r["first_ord"], r["differs_in"]) for r in d.collect()}
    assert got == {"equal.json": ("equal", None, None), "gone.json": ("missing", None, None), "new.json": ("extra", None, None), "count.jsonl": ("differs", None, "count"), "field.json": ("differs", 1, "b"), "keys.json": ("differs", 0, "keys"), "whole.json": ("differs", 1, "record"), "gap.jsonl": ("equal", None, None), "type.json": ("differs", 0, "record"), "none.json": ("equal", None, None)}
    assert not R.same(d) and R.same(d.where("verdict in ('equal', 'extra')"))
