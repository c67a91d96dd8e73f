import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from corpusmill.llm import queries, spelling

DOCS = "doc_id long, text string, word string, n string, id string"
SF = "/root/testdata/sf0.001"


def counted(rows):
    c = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            c[w] += len(w) >= 5
    return {w: n for w, n in c.items() if n >= 3}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def grouped(c):
    """By deletion neighbourhoods, which hold every pair one edit apart."""
    by = {}
    for w in c:
        for x in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            by.setdefault(x, set()).add(w)
    near = {w: set() for w in c}
    for g in by.values():
        for a in g:
            near[a] |= {b for b in g if one_edit(a, b)}
    form = {}
    for w, ns in near.items():
        if ns:
            m, f = min((-c[x], x) for x in ns)
            if -m >= 2 * c[w]:
                form[w] = f
    out = set()
    for w in c:
        r = w
        while r in form:
            r = form[r]
        out.add((w, form.get(w), r, c[w], len(near[w]), c[form[w]] if w in form else None))
    return out


def queried(spark, df):
    return spelling.spelling_variants(spelling.word_counts(df, respell=spelling.with_a_slip))


def test_words_and_forms_against_brute_force(spark):
    r = random.Random(3)
    stems = ["".join(r.choice("abcdeéÀ×") for _ in range(r.randrange(4, 12))) for _ in range(60)]

    def slip(w):
        k = r.randrange(len(w))
        return r.choice([w, w, w, w[:k] + w[k + 1 :], w[:k] + r.choice("abÉz") + w[k:], w[:k] + r.choice("abz") + w[k + 1 :], w.upper()])

    rows = [(None if i == 7 else i // 2, r.choice([" ", "-", "1", "\n", "ı", "Ā"]).join(slip(r.choice(stems)) for _ in range(r.randrange(90)))) for i in range(300)]
    rows += [(1, None), (2, ""), (3, "x" * 5000 + " " + "hello " * 3000), (4, "hello " * 8 + "hallo " * 3 + "halloo " * 3), rows[5], rows[5]]
    got = queried(spark, spark.createDataFrame([(i, t, "w", "n", "i") for i, t in rows], DOCS))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = grouped(counted(rows))
    assert {tuple(x) for x in got.collect()} == want and got.count() == len(want)
    assert any(f and root != f for _, f, root, *_ in want) and any(re.search("[À-ÿ]", w[0]) for w in want)


def test_pairs_are_whole_and_come_once(spark):
    r = random.Random(9)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randrange(1, 9))) for _ in range(900)})
    got = spelling.one_edit_pairs(spark.createDataFrame([(w, 1, "x") for w in words], "word string, n long, of string")).select("a", "b").collect()
    pairs = [frozenset(x) for x in got]
    assert len(set(pairs)) == len(pairs) and set(pairs) == {frozenset((a, b)) for a in words for b in words if a < b and one_edit(a, b)}


def test_roots_follow_long_chains_and_hot_forms(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [(f"x{i}", "w3") for i in range(500)]
    got = dict(map(tuple, spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()))
    assert got == {w: "w37" for w, _ in chain}


def test_empty_tables(spark):
    assert queried(spark, spark.createDataFrame([], DOCS)).collect() == []
    assert queried(spark, spark.createDataFrame([(1, None, "", "", ""), (None, "", "", "", "")], DOCS)).collect() == []


def test_query_against_brute_force(spark):
    docs = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op12_spelling_variants(spark, SF)
    assert {tuple(x) for x in got.collect()} == grouped(counted(docs)) and got.where(F.col("form").isNotNull()).count() > 0
