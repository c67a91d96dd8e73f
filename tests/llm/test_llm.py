import base64
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest

from corpusmill.llm import chats, embedding_dedup, licenses, media, mixing, ngram_join, pieces, toxicity, url_lists, warc

DOCS = "doc_id long, text string, source string, token string, id string"
WORDS = [f"w{i}" for i in range(400)]


def docs(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, (sources or {}).get(i, "s"), "x", "y") for i, t in enumerate(texts)], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_media(spark):
    texts = [None, "", "abc", "é" * 576, "ab " * 200_000, "abc"]
    df = media.audio_features(docs(spark, texts))
    raw = {r["doc_id"]: r for r in df.collect()}
    got = {r["doc_id"]: r for r in media.digest(df).collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        want = b + b"\xff" * (-len(b) % 576 or (0 if b else 576))
        assert bytes(media.from_wav(raw[i]["media"])[1]) == want
        g = got[i]
        assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) == (len(b), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
        assert g["media_sha256"] == hashlib.sha256(raw[i]["media"]).hexdigest() and g["media_bytes"] == len(raw[i]["media"])
    assert got[2]["feature"] == got[5]["feature"] != got[3]["feature"]
    t = media.read_tensors(raw[4]["tensors"])
    assert t.schema.field("logmel").type.shape == [32, 32] and t.num_rows == raw[4]["n_tensors"] > 1
    assert media.digest(media.audio_features(empty(spark))).collect() == []


def test_resampling_blocks_agree_with_one_convolution():
    e = media.Extractor(media.AudioSpec())
    x = np.random.default_rng(1).integers(0, 256, 5000).astype(np.uint8)
    y = (x.astype(float) - 128) / 128
    half = 10 * 5
    t = np.arange(-half, half + 1)
    h = np.sinc(t / 5) * np.kaiser(2 * half + 1, 8.0)
    h *= 2 / h.sum()
    up = np.zeros(10_000)
    up[::2] = y
    want = np.convolve(up, h)[half : half + 10_000][::5]
    got = np.concatenate([e.resampled(x, a, min(a + 500, 2000)) for a in range(0, 2000, 500)])
    assert np.allclose(got, want, atol=1e-4)


def test_licenses(spark):
    mit = licenses.KNOWN["MIT"][0]
    texts = [mit, "Copyright (c) 2020 A\n\n" + mit.upper().replace(",", " ;"), "Licenced under the Apache Licence, version 2.0", mit + " x", None, "", "...", "nothing"]
    out = licenses.license_scan(docs(spark, texts), licenses.digest_table(spark)).orderBy("doc_id").collect()
    assert [r["license"] for r in out] == ["MIT", "MIT", "Apache-2.0", None, None, None, None, None]
    assert licenses.license_scan(empty(spark), licenses.digest_table(spark)).collect() == []


def test_toxicity(spark):
    rng = np.random.default_rng(0)
    words = lambda n: " ".join(rng.choice(WORDS, n))
    texts = [words(60) + (" zorkfoo du" if i % 3 == 0 else "") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id long, toxic int")
    d = docs(spark, texts)
    lexicon = toxicity.learn(d, labels)
    out = toxicity.toxicity(d, lexicon).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    assert all(r["predicted"] == int(r["doc_id"] % 3 == 0) for r in out)
    odd = toxicity.toxicity(docs(spark, ["you 1d10t", "an іdiοt", "the trash can", None, "", "x" * 200_000, "idiot"]), lexicon).orderBy("doc_id").collect()
    assert [r["matches"] for r in odd] == [1, 1, 0, 0, 0, 0, 1]
    assert all(0 <= r["score"] <= 1 for r in odd)
    none = toxicity.learn(empty(spark), labels.limit(0))
    assert toxicity.toxicity(empty(spark), none).collect() == []


def test_toxicity_reads_digits_at_both_ends_of_words():
    lexicon = toxicity.Lexicon({k: 3.0 for k in toxicity.SEEDS})
    a = lexicon.automaton()
    bad = ["whor3", "dumba55", "dumba$$", "put4", "l0s3r5", "m0r0n5", "!d10t", "1d10t", "idiot", "idiot!", "!idiot", "(whor3)", "WHOR3.", "$lut", "l0s3r5!"]
    assert [x for x in bad if lexicon.mass(f"you {x} there", a)[1] != 1 or lexicon.mass(x, a)[1] != 1] == []
    good = ["mail4", "a$$$", "455", "$100", "1234567", "trash can", "room 5", "w5", "4" * 2000]
    assert [x[:20] for x in good if lexicon.mass(x, a)[1]] == []
    assert lexicon.mass("ß\u200b é whor3 and whore", a)[1:] == (2, 5)


def test_url_lists(spark):
    entries = spark.sql("select domain, date(d) date, action from values ('a.com','2024-01-10','add'),('a.com','2024-02-01','remove'),('x.a.com','2024-03-01','add'),('b.org','2024-01-01','remove'),(null,'2024-01-01','add') t(domain,d,action)")
    caps = spark.sql("select page_id, url, date(d) fetched from values (1L,'http://x.a.com/p','2024-01-09'),(2L,'HTTP://u@X.A.com:80/p','2024-01-10'),(3L,'http://a.com','2024-02-01'),(4L,'http://x.a.com','2024-03-01'),(5L,null,'2024-03-01'),(6L,'junk','2024-03-01'),(7L,'http://a.com',null) t(page_id,url,d)")
    out = url_lists.temporal_list_join(caps, entries).orderBy("page_id").collect()
    assert [r["matched_domain"] for r in out] == [None, "a.com", None, "x.a.com", None, None, None]
    assert url_lists.temporal_list_join(caps.limit(0), entries).collect() == []


def smallest(n, pairs):
    root = list(range(n))
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 64))
    x = [b / np.linalg.norm(b) for b in base for _ in range(4)]
    x = [np.float32(v + rng.standard_normal(64) * s / 8).tolist() for v, s in zip(x, itertools.cycle([0, 0.05, 0.13, 0.2]))]
    x += [x[0], x[0], None, [0.0] * 64, [float("nan")] + [1.0] * 63, [None] * 64]
    lab = [i // 4 % 3 for i in range(len(x) - 6)] + [0, 1, 0, 0, 0, 0]
    df = spark.createDataFrame([(i, v, k) for i, (v, k) in enumerate(zip(x, lab))] + [(len(x), x[0], None)], "vec_id long, embedding array<float>, label int")
    n = len(x) + 1
    good = lambda v: v is not None and None not in v and np.isfinite(v).all() and any(v)
    u = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if good(v) else None for v in x] + [None]
    pairs = [(a, b) for a, b in itertools.combinations(range(n - 1), 2) if lab[a] == lab[b] and u[a] is not None and u[b] is not None and u[a] @ u[b] >= 0.98]
    out = embedding_dedup.embedding_neighbours(df).orderBy("vec_id").collect()
    assert [r["component_id"] for r in out] == smallest(n, pairs)
    assert [r["n_links"] for r in out] == [sum(i in p for p in pairs) for i in range(n)]
    assert embedding_dedup.embedding_neighbours(df.limit(0)).collect() == []


def test_embeddings_of_two_lengths(spark):
    rng = np.random.default_rng(4)
    x = []
    for d, n in ((64, 150), (768, 40), (3, 1)):
        for _ in range(n):
            u, v = rng.standard_normal((2, d))
            u /= np.linalg.norm(u)
            v -= (v @ u) * u
            x += [u, 0.985 * u + math.sqrt(1 - 0.985**2) * v / np.linalg.norm(v)]
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    out = embedding_dedup.embedding_neighbours(df).orderBy("vec_id").collect()
    assert [(r["n_links"], r["component_id"]) for r in out] == [(1, i // 2 * 2) for i in range(len(x))]


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join(spark, seed):
    rng = np.random.default_rng(seed)
    texts = [None, "", " \t", "a b", "A  B", "a b c d", "solo"]
    for _ in range(12):
        base = list(rng.choice(WORDS, int(rng.integers(20, 300))))
        for _ in range(8):
            t = list(base)
            for k in rng.integers(0, len(t), int(rng.integers(0, max(1, len(t) // 30) + 1))):
                t[k] = rng.choice(WORDS)
            texts.append(" ".join(t))
    texts += [texts[-1], texts[20], "common line here again " * 3 + "p q", "common line here again " * 3 + "r s"]

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()

    s = [shingles(t) for t in texts]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(s)), 2) if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b])]
    out = ngram_join.ngram_jaccard_components(docs(spark, texts)).orderBy("doc_id").collect()
    assert [r["n_shingles"] for r in out] == [len(x) for x in s]
    assert [r["component_id"] for r in out] == smallest(len(s), pairs)
    assert ngram_join.ngram_jaccard_components(empty(spark)).collect() == []


def wanted(size):
    """Targets by repeated sharing."""
    order = sorted((k for k in size if k is not None)) + [None] * (None in size)
    w = {k: [3, 1, 2][i % 3] for i, k in enumerate(order)}
    budget, want, open_ = 1.5 * sum(size.values()), {}, set(order)
    while open_:
        share = {k: budget * w[k] / sum(w[x] for x in open_) for k in open_}
        over = {k for k in open_ if share[k] > 2 * size[k]}
        if not over:
            want |= share
            break
        for k in over:
            want[k] = 2 * size[k]
            budget -= want[k]
        open_ -= over
    return want


def test_mixing(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(["w"] * int(rng.integers(0, 60))) for _ in range(900)] + [None]
    sources = {i: [None, "a", "b", "c"][i % 4] if i % 10 else "a" for i in range(901)}
    d = docs(spark, texts, sources)
    out = mixing.mix(d, block_docs=16, shard_blocks=4).collect()
    again = mixing.mix(d.repartition(5), block_docs=16, shard_blocks=4).collect()
    assert sorted(map(str, out)) == sorted(map(str, again)) and len(out) == 901
    size = {}
    for r in out:
        size[r["source"]] = size.get(r["source"], 0) + r["size"]
    want = wanted(size)
    _, t, _, filled = mixing.planned(d, "doc_id", "text", "source", (3, 1, 2), 1.5, 2.0, 7, 4, 16, 3)
    least = {r["source"]: r["s"] for r in filled.where("size > 0 and more < n").join(t.select("rank", "source"), "rank").groupBy("source").agg({"size": "min"}).toDF("source", "s").collect()}
    for k in want:
        rows = [r for r in out if r["source"] == k]
        assert all(abs(r["target"] - want[k]) < 1e-6 and r["source_size"] == size[k] and r["taken"] == r["size"] * len(r["shards"]) <= 2 * r["size"] for r in rows)
        assert 0 <= want[k] + 1e-6 - sum(r["taken"] for r in rows) < least.get(k, 1)
    shards = [s for r in out for s in r["shards"]]
    assert len(set(shards)) >= 16 and max(shards) == len(set(shards)) - 1
    got = mixing.mixed(d, block_docs=16, shard_blocks=4)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in out for _ in r["shards"]) and got.columns == d.columns
    assert mixing.mix(empty(spark)).collect() == [] == mixing.mixed(empty(spark)).collect()


def test_mixing_goes_on_behind_a_long_text(spark):
    rng = np.random.default_rng(5)
    n = rng.integers(3, 60, 3000)
    n[::1000] = n.sum() // 12
    d = docs(spark, ["w " * int(x) for x in n], {i: "ab"[i % 2] for i in range(3000)})
    for seed in range(3):
        out = mixing.mix(d, seed=seed).collect()
        for s in "ab":
            rows = [r for r in out if r["source"] == s]
            assert 0 <= rows[0]["target"] - sum(r["taken"] for r in rows) < 10


def test_mixing_repeated_rows_and_null_ids(spark):
    text = lambda n: " ".join(["w"] * n)
    rows = [(i % 10 if i < 30 else None, text(5 + i % 10 if i < 30 else i), "s") for i in range(40)] + [(1, text(3), "s"), (1, None, "s"), (2, "", "s")] * 2
    rows += [(7, text(4), "t")] * 500 + [(k, text(9), "t") for k in range(9)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(d).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], r["size"]) for r in out), key=key) == sorted(((i, len((t or "").split())) for i, t, _ in rows), key=key)
    for s in "st":
        mine = [r for r in out if r["source"] == s]
        assert 0 <= mine[0]["target"] - sum(r["taken"] for r in mine) < 10
        assert all(r["taken"] <= 2 * r["size"] for r in mine)
    got = mixing.mixed(d).collect()
    assert sorted(((r["doc_id"], len(r["text"].split())) for r in got), key=key) == sorted(((r["doc_id"], r["size"]) for r in out for _ in r["shards"]), key=key)


def test_pieces(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    plain, varied = pieces.Pieces(dropout=0), pieces.Pieces(dropout=0.3)
    texts = ["Hello world, this is a test.", "  two  spaces ", "línea\nñandú 😀\t", "a▁b", "x" * 3000, "the the the the"]
    for t in texts:
        if "▁" not in t:
            assert plain.encode(t) == sp.encode(t)
        assert plain.decode(plain.encode(t)) == t == varied.decode(varied.encode(t, 5))
    assert varied.encode(texts[0], 1) != plain.encode(texts[0])
    out = pieces.encode(docs(spark, [None, "", *texts, texts[0]])).orderBy("doc_id").collect()
    assert all(r["lossless"] and r["n_tokens"] == len(r["ids"]) for r in out) and out[0]["ids"] == []
    assert pieces.encode(empty(spark)).collect() == []


def test_pieces_draw_for_every_occurrence(spark):
    p = pieces.Pieces(dropout=0.2)
    words = ["▁internationalisation", "▁the", "▁cat", "▁" + "ab" * 60]
    text = " ".join(w[1:] for w in words * 50)
    seen = {w: set() for w in words}
    for key in range(3):
        keys = pieces._mix(np.full(200, key, np.uint64) + np.arange(1, 201, dtype=np.uint64) * pieces._G1)
        want = []
        for w, k in zip(words * 50, keys):
            drawn = pieces._mix(k + np.arange(1, 3 * len(w), dtype=np.uint64) * pieces._G2) < p.limit
            want.append(p.segment(w, set(np.flatnonzero(drawn).tolist()))[1])
            seen[w].add(want[-1])
        assert p.encode(text, key) == [x for ids in want for x in ids]
    assert len(seen[words[0]]) > 20
    out = pieces.encode(docs(spark, ["internationalisation"] * 200)).collect()
    assert len({tuple(r["ids"]) for r in out}) > 4
    # A chunk of one candidate stays whole in nine of ten draws.
    one = next(w for w in ("▁a", "▁t", "▁s") if p.segment(w, ())[0] == 1)
    tenth = pieces.Pieces(dropout=0.1)
    split = sum(len(tenth.encode(one[1:], key)) > 1 for key in range(5000))
    assert 400 < split < 600


def test_chats(spark):
    talk = [("user", "hi"), ("assistant", "hello"), ("user", None), ("assistant", "<|im_end|>")]
    convs = {1: talk[:1], 2: talk[:2], 3: talk, 4: talk, 5: [("user", "hi"), ("assistant", "other")], 6: [("user", None)], 7: [("user", "")]}
    rows = [(c, k, r, t) for c, ts in convs.items() for k, (r, t) in enumerate(ts)] + [(None, 0, "user", "x")]
    out = chats.collapse_snapshots(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id").collect()
    assert [(r["conv_id"], r["n_turns"], r["copies"]) for r in out] == [(3, 4, 2), (5, 2, 1), (6, 1, 1), (7, 1, 1)]
    assert out[1]["rendered"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nother<|im_end|>\n"


def test_warc(spark):
    html = ["<p>é</p>\r\n\r\nWARC/1.1\r\n", None, "", "same", "same", "x" * 500_000]
    pages = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    out = {int(r["record_id"].split(":")[-1][:-1]): r for r in warc.round_trip(pages, payload=True).collect()}
    assert len(out) == len(html)
    for i, h in enumerate(html):
        b, r = (h or "").encode(), out[i]
        assert r["digest"] == base64.b32encode(hashlib.sha1(b).digest()).decode() and r["payload_bytes"] == len(b)
        again = {1: 2, 3: 4}.get(i)
        assert (r["record_type"], r["refers_to"]) == (("revisit", out[again]["record_id"]) if again is not None else ("response", None))
        assert again is not None or r["payload"] == b
        assert r["request"]["fields"].startswith("GET ") and r["metadata"]["fields"] == f"pageId: {i}\r\n"
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_warc_keeps_rows_that_repeat_an_id_or_have_none(spark):
    rows = [(1, "u", "a"), (1, "u", "b"), (1, "v", "b"), (None, "w", "a"), (None, "w", "c"), (-5, None, "c"), (2, "x", None)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    out = warc.round_trip(pages).collect()
    number = lambda c: c and (int(n) if (n := c.split(":")[-1][:-1]) else None)
    got = sorted(((number(r["record_id"]), r["payload_bytes"], r["record_type"], number(r["refers_to"])) for r in out), key=str)
    assert got == sorted([(1, 1, "response", None), (1, 1, "response", None), (1, 1, "revisit", 1), (None, 1, "revisit", 1), (None, 1, "revisit", -5), (-5, 1, "response", None), (2, 0, "response", None)], key=str)


def test_embeddings_with_repeated_and_null_ids(spark):
    rng = np.random.default_rng(6)
    x, y = rng.standard_normal((2, 64))
    rows = [(1, x, 0), (1, x, 0), (2, x * 2, 0), (2, x * 2, 0), (3, y, 0), (3, x, 0), (None, y, 0), (None, None, 0), (9, -y, 0)]
    df = spark.createDataFrame([(i, None if v is None else v.tolist(), k, 5) for i, v, k in rows], "vec_id long, embedding array<double>, label int, copies int")
    out = sorted(map(tuple, embedding_dedup.embedding_neighbours(df).collect()), key=str)
    assert out == sorted([(1, 4, 1, True)] * 2 + [(2, 4, 1, False)] * 2 + [(3, 4, 1, False), (3, 1, 3, True), (None, 1, 3, False), (None, 0, None, False), (9, 0, 9, True)], key=str)


def test_embedding_recall_against_brute_force(spark):
    """All linked pairs of the table of sf0.1, and pairs planted at the bound."""
    rng = np.random.default_rng(8)
    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    rows = [(r["vec_id"], list(map(float, r["embedding"])), r["label"]) for r in t if r["embedding"] is not None and r["label"] is not None and np.isfinite(np.array(r["embedding"], float)).all()]
    for k in range(300):
        u, v = rng.standard_normal((2, 64))
        u /= np.linalg.norm(u)
        v -= (v @ u) * u
        rows += [(10**6 + 2 * k, u.tolist(), 0), (10**6 + 2 * k + 1, (0.9801 * u + math.sqrt(1 - 0.9801**2) * v / np.linalg.norm(v)).tolist(), 0)]
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    want = ((x @ x.T >= 0.98) & (label[:, None] == label)).sum(axis=1) - 1
    out = {r["vec_id"]: r["n_links"] for r in embedding_dedup.embedding_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    got = np.array([out[r[0]] for r in rows])
    assert (got <= want).all() and got.sum() >= 0.99 * want.sum() > 0


def test_toxicity_exceptions_in_one_sweep():
    rng = np.random.default_rng(9)
    for _ in range(50):
        best = {int(k): 1.0 for k in rng.integers(0, 80, 12)}
        spans = [(a, a + int(rng.integers(1, 15))) for a in rng.integers(0, 80, 6).tolist()]
        assert toxicity.outside(best, spans) == {k: 1.0 for k in sorted(best) if not any(a <= k < z for a, z in spans)}
    lexicon = toxicity.Lexicon({"trash": 1.0}, ("trash can",))
    assert lexicon.mass("trash can " * 30_000 + "trash", lexicon.automaton())[1] == 1


def test_toxicity_matches_agree_with_a_plain_search():
    rng = np.random.default_rng(10)
    lexicon = toxicity.Lexicon({"idiot": 2.0, "idio*": 1.0, "scum": 1.5, "trash": 1.0}, ("pond scum", "trash can"))
    a = lexicon.automaton()
    words = ["idiot", "idiotic", "scum", "pond", "trash", "can", "trashy", "x", "SCUM", "sсum"]
    for _ in range(200):
        text = " ".join(rng.choice(words, int(rng.integers(0, 30))))
        w = [x.lower().replace("с", "c") for x in text.split()]
        weights = [{"idiot": 2.0, "idiotic": 1.0, "scum": 1.5, "trash": 1.0}.get(x, 0) if not (x == "scum" and k and w[k - 1] == "pond" or x == "trash" and w[k + 1 : k + 2] == ["can"]) else 0 for k, x in enumerate(w)]
        assert lexicon.mass(text, a) == (sum(weights), sum(x > 0 for x in weights), len(w))


def test_url_lists_judge_every_row(spark):
    entries = spark.sql("select domain, date(d) date, action from values ('a.com','2024-01-10','add'),('10.0.0.1','2024-01-01','add'),('0.1','2024-01-01','add'),('::1','2024-01-01','add') t(domain,d,action)")
    caps = spark.sql("select page_id, url, date(d) fetched, 'x' host from values (1L,'http://x.a.com/p','2024-01-11'),(1L,'http://b.org','2024-01-11'),(null,'http://a.com','2024-01-11'),(null,'http://[::1]:80/','2024-01-11'),(3L,'http://10.0.0.1/','2024-01-11'),(4L,'http://9.0.0.1/','2024-01-11'),(5L,'http://a.com','2024-01-09') t(page_id,url,d)")
    key = lambda r: str(r)
    got = sorted(((r["page_id"], r["host"], r["matched_domain"]) for r in url_lists.temporal_list_join(caps, entries).collect()), key=key)
    assert got == sorted([(1, "x.a.com", "a.com"), (1, "b.org", None), (None, "a.com", "a.com"), (None, "::1", "::1"), (3, "10.0.0.1", "10.0.0.1"), (4, "9.0.0.1", None), (5, "a.com", None)], key=key)
    assert not any(r["blocked"] for r in url_lists.temporal_list_join(caps, entries.limit(0)).collect())


def test_ngram_join_null_and_repeated_ids_and_long_texts(spark):
    rng = np.random.default_rng(11)
    long = list(rng.choice(WORDS, 30_000))
    near = list(long)
    near[100] = "other"
    copy = " ".join(rng.choice(WORDS, 40))
    rows = [(1, copy), (1, copy), (None, copy), (None, "only here it stands alone"), (None, None), (2, " ".join(long)), (3, " ".join(near)), (4, "x" * 100_000 + " b c d e"), (5, "X" * 100_000 + " b c d e"), (6, None), (6, None)]
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n long, token long")
    out = sorted(map(tuple, ngram_join.ngram_jaccard_components(d).collect()), key=str)
    n = lambda w: len({tuple(w[i : i + 4]) for i in range(len(w) - 3)})
    want = [(1, n(copy.split()), 1)] * 2 + [(None, n(copy.split()), 1), (None, 2, None), (None, 0, None), (2, n(long), 2), (3, n(near), 2), (4, 2, 4), (5, 2, 4), (6, 0, 6), (6, 0, 6)]
    assert out == sorted(want, key=str)


def test_components_by_rounds_and_at_once(spark):
    from corpusmill.llm.components import components

    rng = np.random.default_rng(12)
    e = [(i, i + 1) for i in range(100, 140)] + [(500, 500 + i) for i in range(50)] + [tuple(map(int, rng.integers(1000, 1080, 2))) for _ in range(45)] + [(None, 3), (4, 4), (7, 5), (5, 7)]
    df = spark.createDataFrame(e, "a long, b long")
    nodes = sorted({x for a, b in e if a is not None and a != b for x in (a, b)})
    root = smallest(len(nodes), [(nodes.index(a), nodes.index(b)) for a, b in e if a is not None and a != b])
    want = {x: nodes[r] for x, r in zip(nodes, root)}
    for few in (0, 16_384):
        assert {r["node"]: r["component"] for r in components(df, few=few).collect()} == want
    assert components(df.limit(0)).collect() == []


def test_pieces_decode_operator(spark):
    texts = [None, "", "a  b\n", "naïve ▁ 😀 " * 50, "internationalisation " * 400]
    encoded = pieces.encode(docs(spark, texts), dropout=0.3)
    assert [r["text"] for r in pieces.decode(encoded).orderBy("doc_id").collect()] == [t or "" for t in texts]


def test_agenda_agrees_with_a_heap_for_random_chunks():
    rng = np.random.default_rng(13)
    p = pieces.Pieces(dropout=0.25)
    alphabet = list("etaoinshrdlucmfwypvbgkqjxz'é日😀▁")
    chunks = ["▁" + "".join(rng.choice(alphabet[:-1], int(rng.integers(1, 80)))) for _ in range(400)] + ["", "▁", "▁▁▁", "x"]
    keys = rng.integers(0, 2**63, len(chunks)).astype(np.uint64)
    ids, n, _ = p.all_of(chunks, keys)
    ends = np.cumsum(n)
    for k, (chunk, key) in enumerate(zip(chunks, keys)):
        drawn = set(np.flatnonzero(pieces._mix(key + np.arange(1, 3 * len(chunk) + 1, dtype=np.uint64) * pieces._G2) < p.limit).tolist())
        assert tuple(ids[ends[k] - n[k] : ends[k]].tolist()) == p.segment(chunk, drawn)[1]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(14)
    texts = [" ".join(rng.choice(WORDS, 60)) for _ in range(60)]
    rows = [(i, t, "en", "s" if i % 3 else "t", len(t)) for i, t in enumerate(texts)]
    rows += [(100, texts[1], "en", "s", 1), (101, texts[2] + " more", "en", "s", 1), (None, texts[3], "en", "s", 1), (None, " ".join(WORDS[:50]), "en", None, 1), (7, " ".join(WORDS[100:150]), "en", "s", 1), (8, None, "en", "s", 0), (8, "", "en", "s", 0), (9, "you utter moron and idiot", "en", "s", 1), (None, "you whor3, scum", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs_, stages = spark.read.parquet(f"{tmp_path}/documents.parquet"), dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs_, str(tmp_path))
    assert clean.columns == docs_.columns and clean.count() == len(rows) - 2
    clean.write.parquet(f"{tmp_path}/clean")
    one = stages["ngram_jaccard_join"](spark, spark.read.parquet(f"{tmp_path}/clean"), str(tmp_path))
    left = [(r["doc_id"], r["text"]) for r in one.collect()]
    assert one.columns == docs_.columns and len(left) == len(rows) - 2 - 3
    for t in (texts[1], texts[3], " ".join(WORDS[:50]), " ".join(WORDS[100:150])):
        assert sum(x == t for _, x in left) == 1
    assert sum((x or "").startswith(texts[2]) for _, x in left) == 1
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r["lossless"] and r["n_tokens"] for r in out)
    words = {}
    for _, t, _, s, _ in (r for r in rows if (r[0], r[1]) in left):
        words[s] = words.get(s, 0) + len((t or "").split())
    assert abs(sum(wanted(words).values()) - sum(len(pieces.Pieces(dropout=0).decode(r["ids"]).split()) for r in out)) < 200


def test_workers_need_not_see_the_package(tmp_path):
    """Python workers get no path to the package: the driver's script adds it to its own only."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parents[2]
    (tmp_path / "job.py").write_text(f"""
import sys
sys.path.append({str(repo)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "ck").getOrCreate()
from corpusmill.llm import embedding_dedup, media, ngram_join, pieces, toxicity
d = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f g"), (3, None)], "doc_id long, text string")
assert pieces.encode(d).count() == pieces.decode(pieces.encode(d)).count() == 3
assert ngram_join.ngram_jaccard_components(d, percent=70).where("component_id = 1").count() == 2
assert toxicity.toxicity(d, toxicity.Lexicon({{"a": 1.0}})).where("matches = 1").count() == 2
assert media.digest(media.audio_features(d)).count() == 3
v = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.01], 0)], "vec_id long, embedding array<double>, label int")
assert embedding_dedup.embedding_neighbours(v).where("component_id = 1").count() == 2
print("all ran")
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run([sys.executable, "job.py"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in ran.stdout, ran.stderr[-3000:]
