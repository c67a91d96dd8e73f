import hashlib
import math
import random
import zlib
from collections import defaultdict
from datetime import datetime, timedelta
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from corpusmill.llm import late_arrivals as L
from corpusmill.llm import queries

SF = "/root/testdata/sf0.001"
SCHEMA = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int"
EPOCH, CUT = datetime(1970, 1, 1), datetime(2024, 3, 20)


def us(t):
    return None if t is None else (t - EPOCH) // timedelta(microseconds=1)


def day(t):
    return -1 if t is None else (t - EPOCH) // timedelta(days=1)


def copies(rows):
    out = []
    for r in rows:
        if r[0] is None:
            continue
        h = zlib.crc32(str(r[0]).encode())
        if h % 3 == 0 and day(r[4]) % 4 == 0:
            out.append((*r[:3], None if r[3] is None else r[3] + 1, r[4] + timedelta(days=h % 2), None if r[5] is None else r[5] + timedelta(days=1 + h % 97), r[6]))
    return rows + out


def low(*v):
    """A key that sorts nulls first."""
    return tuple((x is not None, x if x is not None else 0) for x in v)


def layout(rows, file_rows):
    best = {}
    for r in rows:
        rank = low(r[5], r[4], r[1], r[2], r[3], r[6])
        if r[0] not in best or rank > best[r[0]][0]:
            best[r[0]] = (rank, r)
    days = defaultdict(list)
    for _, r in best.values():
        days[day(r[4])].append(r)
    out = {}
    for d, rs in days.items():
        rs.sort(key=lambda r: low(r[4], r[0]))
        out |= {(d, i // file_rows): rs[i : i + file_rows] for i in range(0, len(rs), file_rows)}
    return out, {k: v[1] for k, v in best.items()}


def expected(rows, files=1100):
    n, rows = 1 + len(rows) // files, copies(rows)
    late = {id(r) for r in rows if r[5] is None or r[5] >= CUT}
    before, was = layout([r for r in rows if id(r) not in late], n)
    after, now = layout(rows, n)
    dirty = {day(r[4]) for r in now.values() if id(r) in late} | {day(was[k][4]) for k, r in now.items() if id(r) in late and k in was}
    text = lambda x: "" if x is None else str(x)
    out = {}
    for (d, i), rs in after.items():
        cents = sum(math.floor(100 * r[3] + 0.5) for r in rs if r[3] is not None)
        crc = sum(zlib.crc32(f"{text(r[0])}:{text(us(r[4]))}:{text(us(r[5]))}".encode()) for r in rs)
        out[d, i] = (len(rs), cents, crc, hashlib.sha256(",".join(text(r[0]) for r in rs).encode()).hexdigest(), d in dirty)
    return out, before


def checked(got, want, names):
    rows = {(r["day"], r["file_no"]): r for r in got}
    assert len(rows) == len(got) and rows.keys() == want.keys()
    for k, r in rows.items():
        assert (r["n_rows"], r["cents"], r["rows_crc"], r["ids_sha256"], r["rewritten"]) == want[k], k
        assert r["columns"] == ",".join(names)
        path = r["path"].removeprefix("file://").removeprefix("file:")
        stored = pq.ParquetFile(path).read()
        assert stored.column_names == names and hashlib.sha256(",".join("" if x is None else str(x) for x in stored["sale_id"].to_pylist()).encode()).hexdigest() == r["ids_sha256"]
    return rows


def made(n, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        sold = None if r.random() < 0.03 else datetime(2024, 1, 1) + timedelta(days=r.choice([3, 3, r.randrange(120)]), seconds=r.randrange(86400), microseconds=r.choice([0, 999999]))
        arrived = None if r.random() < 0.02 else (sold or datetime(2024, 2, 1)) + timedelta(seconds=r.randrange(200_000))
        key = None if r.random() < 0.01 else r.choice([i, i, 7, r.randrange(n)])
        out.append((key, r.randrange(9), r.choice(["done", None]), r.choice([None, r.randrange(10**6) / 100, -0.005]), sold, arrived, r.randrange(5)))
    return out + out[:5]


@pytest.mark.parametrize("n", [0, 1, 40, 1_500])
def test_layout_merge_and_report_against_brute_force(spark, n):
    rows = made(n) if n else []
    want, _ = expected(rows, 150)
    got = L.overwritten(spark.createDataFrame(rows, SCHEMA), files=150).collect()
    checked(got, want, [c.split()[0] for c in SCHEMA.split(", ")])
    assert n < 1_000 or any(r["rewritten"] for r in got) and not all(r["rewritten"] for r in got)


def test_untouched_files_stay_byte_identical_and_none_are_left_over(spark, tmp_path):
    rows = copies(made(900, 2))
    early, late = ([r for r in rows if (r[5] is not None and r[5] < CUT) == side] for side in (True, False))
    lay = L.lay_out(spark.createDataFrame(early, SCHEMA), f"file://{tmp_path}/x", 3)
    files = lambda: {str(p): p.read_bytes() for p in Path(tmp_path).rglob("*.parquet") if "/index/" not in str(p)}
    before = files()
    days = L.merge_late(spark, lay, spark.createDataFrame(late, SCHEMA))
    after = files()
    clean = {p for p in before if int(p.split("day=")[1].split("/")[0]) not in days}
    assert clean and all(after.get(p) == before[p] for p in clean) and {p for p in after if p in before} == clean
    want, _ = layout(rows, 3)
    assert len(after) == len(want) == L.listing(spark, lay).count()
    assert sorted(p.name for p in (tmp_path / "x").iterdir()) == ["files", "index"]


def test_a_day_that_empties_has_no_files_and_late_rows_that_lose_change_nothing(spark, tmp_path):
    d = lambda k, h=0: datetime(2024, 1, k, h)
    early = [(1, 1, "a", 1.0, d(2), d(2, 1), 1), (2, 1, "a", 1.0, d(3), d(3, 1), 1), (3, 1, "a", 1.0, d(4), d(9), 1)]
    lay = L.lay_out(spark.createDataFrame(early, SCHEMA), f"file://{tmp_path}/x", 10)
    late = [(1, 1, "a", 2.0, d(3), d(5), 1), (3, 1, "a", 9.0, d(5), d(8), 1), (2, 1, "a", 9.0, d(7), None, 1)]
    days = L.merge_late(spark, lay, spark.createDataFrame(late, SCHEMA))
    assert days == [day(d(2)), day(d(3))]
    assert sorted((r["sale_id"], r["total"], r["day"]) for r in lay.read(spark).collect()) == [(1, 2.0, day(d(3))), (2, 1.0, day(d(3))), (3, 1.0, day(d(4)))]
    assert not (tmp_path / "x/files" / f"day={day(d(2))}").exists()
    assert L.merge_late(spark, lay, spark.createDataFrame([], SCHEMA)) == []


def test_clashing_columns_and_times_with_a_zone(spark, tmp_path):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([(1, datetime(2024, 3, 10, 2, 30), 5, "u" * 100_000), (2, None, 6, None)], "sale_id long, sold_at timestamp_ntz, day int, file string").withColumn("arrived_at", L.F.timestamp_micros(L.F.lit(5)))
        lay = L.lay_out(df, f"file://{tmp_path}/x", 1)
        assert (lay.day, lay.file) == ("_day", "_file") and lay.read(spark).select(df.columns).dtypes == df.dtypes
        assert sorted((r["_day"], r["day"], len(r["file"] or "")) for r in lay.read(spark).collect()) == [(-1, 6, 0), (19792, 5, 100_000)]
        assert df.select(L.micros(df, "sold_at"), L.micros(df, "arrived_at")).first()[:] == (us(datetime(2024, 3, 10, 2, 30)), 5)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_query_against_brute_force(spark):
    rows = list(map(tuple, spark.read.parquet(f"{SF}/sales.parquet").collect()))
    got = queries.op11_late_arrivals(spark, SF)
    want, _ = expected(rows)
    checked(got.collect(), want, [c.split()[0] for c in SCHEMA.split(", ")])
    assert got.columns == ["day", "file_no", "n_rows", "cents", "rows_crc", "path", "columns", "ids_sha256", "rewritten"]
