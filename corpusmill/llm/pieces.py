"""SentencePiece BPE with seeded merge-dropout, and lossless decoding."""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, kept

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_CHUNKS = re.compile("▁*[^▁]+|▁+")


_G1, _G2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_WIDTHS = (6, 9, 12, 16, 24, 40, 64)
_NONE = np.int32(2**31 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit values (the finalizer of splitmix64); x is overwritten."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _spread(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each run of n, one run after the other."""
    return np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)


class _Store:
    """Runs of ids, appended one after the other."""

    def __init__(self):
        self.ids, self.start, self.n, self.used, self.rows = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0, 0

    def add(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Row numbers of the runs of n ids each."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.rows + len(n) > len(self.n):
            self.start, self.n = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.n))
        rows = np.arange(self.rows, self.rows + len(n))
        self.start[rows], self.n[rows], self.ids[self.used : self.used + len(ids)] = self.used + np.cumsum(n) - n, n, ids
        self.used, self.rows = self.used + len(ids), self.rows + len(n)
        return rows


class Pieces:
    """Encoder and decoder of a BPE model with byte fallback. A chunk is a word with the spaces before it: no piece has a space after another character, so merges stay in chunks."""

    def __init__(self, model: str = MODEL, dropout: float = 0.1, seed: int = 1, cache_ids: int = 2_000_000, cache_chars: int = 4_000_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(pieces) if sp.is_byte(i)}
        byte_of = {i: b for b, i in self.bytes.items()}
        self.ids = {p: i for i, p in enumerate(pieces) if i not in special and i not in byte_of}
        plain = [bytes([byte_of[i]]) if i in byte_of else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.plain, self.plain_n = np.frombuffer(b"".join(plain), np.uint8), np.array([len(x) for x in plain])
        self.plain_start = np.cumsum(self.plain_n) - self.plain_n
        # The agenda's order: the score falls as the rank grows.
        scores = {p: -sp.get_score(i) for p, i in self.ids.items()}
        order = {s: r for r, s in enumerate(sorted(set(scores.values())))}
        self.rank = {p: order[s] for p, s in scores.items()}
        if any(re.search("[^▁]▁", p) for p in self.ids):
            raise ValueError("a piece spans words")
        # Symbols of merges: pieces by id, then characters that only stand in pieces. Every way to make a piece of two symbols.
        symbols = self.ids | {c: n + k for k, c in enumerate(sorted({c for p in self.ids for c in p} - self.ids.keys()))}
        self.of_char = np.full(0x110000, -1, np.int32)
        for c, s in symbols.items():
            if len(c) == 1:
                self.of_char[ord(c)] = s
        made = sorted((symbols[p[:k]] << 20 | symbols[p[k:]], self.rank[p], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols)
        self.pair, self.pair_rank, self.pair_to = (np.array(x, kind) for x, kind in zip(zip(*made), (np.int64, np.int32, np.int32)))
        self.byte_ids = np.array([self.bytes[b] for b in range(256)], np.int32)
        self.n_pieces = n
        self.drop, self.limit, self.seed = dropout > 0, np.uint64(min(int(dropout * 2**64), 2**64 - 1)), seed
        self.mark = tuple(self.bytes[x] for x in "▁".encode())
        self.cache_ids, self.cache_chars = cache_ids, cache_chars
        self.forget()

    def forget(self) -> None:
        self.rows, self.chars, self.store, self.met = {}, 0, _Store(), np.zeros(1 << 14, np.int64)

    def segment(self, chunk: str, skips) -> tuple[int, tuple[int, ...]]:
        """(candidate merges met, ids) of one chunk. Merges come off an agenda by score, then place; the t-th is skipped if t is in skips.

        A symbol is a span that begins at i and ends where the next begins, end[i]; offered[i] is the rank of
        its merge with the next symbol, -1 if there is none or it was skipped, so stale entries show. The
        empty chunk stands for a literal U+2581. This is for chunks of any length; agenda() does the same
        for many short ones.
        """
        if not chunk:
            return 0, self.mark
        n, rank, get, t = len(chunk), self.rank, self.ids.get, 0
        end, before, offered, agenda = list(range(1, n + 1)), list(range(-1, n)), [-1] * n, []
        for i, r in enumerate(map(rank.get, map(str.__add__, chunk, chunk[1:]))):
            if r is not None:
                offered[i] = r
                agenda.append(r << 32 | i)
        heapq.heapify(agenda)
        while agenda:
            x = heapq.heappop(agenda)
            i = x & 0xFFFFFFFF
            if offered[i] != x >> 32:
                continue
            j = end[i]
            t += 1
            if skips and t - 1 in skips:
                offered[i] = -1
                continue
            end[i] = e = end[j]
            offered[i] = offered[j] = -1
            if e < n:
                before[e] = i
                r = rank.get(chunk[i : end[e]])
                if r is not None:
                    offered[i] = r
                    heapq.heappush(agenda, r << 32 | i)
            if i:
                p = before[i]
                r = rank.get(chunk[p:e])
                offered[p] = -1
                if r is not None:
                    offered[p] = r
                    heapq.heappush(agenda, r << 32 | p)
        out, i = [], 0
        while i < n:
            k = get(chunk[i : end[i]])
            if k is not None:
                out.append(k)
            else:
                out += [self.bytes[x] for x in chunk[i : end[i]].encode("utf-8", "surrogatepass")]
            i = end[i]
        return t, tuple(out)

    def merge(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) that two symbols make; _NONE where they make none."""
        q = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.pair, q), len(self.pair) - 1)
        hit = self.pair[at] == q
        return np.where(hit, self.pair_rank[at], _NONE), self.pair_to[at]

    def agenda(self, chunks: list[str], keys: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """segment() of many chunks of similar length, at most 64 characters: (ids, ids in each, merges made in each). A candidate is skipped by its chunk's key and its number.

        Column c of the arrays is a chunk, row i its place i; the last row stands for no symbol. Each turn takes
        every chunk's first candidate off its agenda, the least rank and place of its column.
        """
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        width, cols = int(size.max()), np.arange(len(chunks))
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        place, col = _spread(np.zeros_like(size), size), np.repeat(cols, size)
        code = np.zeros((width, len(chunks)), np.uint32)
        code[place, col] = codes
        sym = np.full((width + 1, len(chunks)), -1, np.int32)
        sym[place, col] = self.of_char[codes]
        nxt = np.arange(1, width + 2, dtype=np.int8)[:, None] * np.ones(len(chunks), np.int8)
        nxt[size - 1, cols] = width
        prv = np.arange(-1, width, dtype=np.int8)[:, None] * np.ones(len(chunks), np.int8)
        prv[0] = width
        key, to = np.full((width + 1, len(chunks)), _NONE, np.int32), np.zeros((width + 1, len(chunks)), np.int32)
        pair = np.flatnonzero(place + 1 < size[col])
        i, c = place[pair], col[pair]
        r, to[i, c] = self.merge(sym[i, c], sym[i + 1, c])
        key[i, c] = np.where(r < _NONE, r << 7 | i.astype(np.int32), _NONE)
        alive = np.zeros((width, len(chunks)), bool)
        alive[place, col] = True
        final, left = np.full((width, len(chunks)), -1, np.int32), alive.copy()
        own, keys = cols, None if keys is None else keys.copy()

        while len(own):
            best = key.min(axis=0)
            on = best < _NONE
            live = np.flatnonzero(on)
            if len(live) < 0.75 * len(own):
                off = np.flatnonzero(~on)
                final[:, own[off]], left[:, own[off]] = sym[:width, off], alive[:, off]
                if not len(live):
                    break
                sym, nxt, prv, key, to, alive, own, best = sym[:, live], nxt[:, live], prv[:, live], key[:, live], to[:, live], alive[:, live], own[live], best[live]
                keys, live = None if keys is None else keys[live], np.arange(len(live))
            c, i = live, best[live] & 127
            if keys is not None:
                keys[c] += _G2
                skip = _mix(keys[c]) < self.limit
                if skip.any():
                    key[i[skip], c[skip]] = _NONE
                    c, i = c[~skip], i[~skip]
            j = nxt[i, c]
            e, p = nxt[j, c], prv[i, c]
            s = sym[i, c] = to[i, c]
            nxt[i, c], prv[e, c], key[j, c], alive[j, c] = e, i, _NONE, False
            for a, x, y in ((i, s, sym[e, c]), (p, sym[p, c], s)):
                r, to[a, c] = self.merge(x, y)
                key[a, c] = np.where(r < _NONE, r << 7 | a.astype(np.int32), _NONE)
        kept_, made = left.T, final.T
        n = kept_.sum(axis=1)
        out, what = made[kept_], code.T[kept_]
        other = np.flatnonzero((out < 0) | (out >= self.n_pieces))
        if not len(other):
            return out, n, size - n
        # A character without a piece gives its bytes.
        u = what[other]
        long = 1 + (u > 0x7F) + (u > 0x7FF) + (u > 0xFFFF)
        many = np.ones(len(out), np.int64)
        many[other] = long
        start = (np.cumsum(many) - many)[other]
        wide = np.repeat(out, many)
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0], np.uint32)[long]
        for k in range(4):
            some = long > k
            shift = (6 * (long - 1 - k)[some]).astype(np.uint32)
            v = u[some] >> shift
            wide[start[some] + k] = self.byte_ids[(v | lead[some]) & 0xFF if k == 0 else (v & 0x3F) | 0x80]
        by = np.repeat(np.arange(len(n)), n)
        return wide, np.bincount(by, many, len(n)).astype(np.int64), size - n

    def all_of(self, chunks: list[str], keys: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ids in each, merges made in each) of chunks of any lengths, in their order."""
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        group = np.searchsorted(_WIDTHS, size)
        group[size == 0] = len(_WIDTHS)
        parts, order = [], []
        for g in range(len(_WIDTHS) + 1):
            rows = np.flatnonzero(group == g)
            if not len(rows):
                continue
            order.append(rows)
            some = [chunks[k] for k in rows.tolist()]
            if g < len(_WIDTHS):
                parts.append(self.agenda(some, None if keys is None else keys[rows]))
                continue
            found = []
            for k, chunk in zip(rows.tolist(), some):
                skips = () if keys is None else set(np.flatnonzero(_mix(keys[k] + np.arange(1, 3 * len(chunk) + 1, dtype=np.uint64) * _G2) < self.limit).tolist())
                found.append(self.segment(chunk, skips))
            parts.append((np.array([x for _, ids in found for x in ids], np.int32), np.array([len(ids) for _, ids in found]), np.array([t for t, _ in found])))
        ids, n, made = (np.concatenate(x) for x in zip(*parts))
        back = np.argsort(np.concatenate(order), kind="stable")
        start = np.cumsum(n) - n
        return ids[_spread(start[back], n[back])], n[back], made[back]

    def plainly(self, found: list[str]) -> np.ndarray:
        """Rows of the store for chunks without skips; chunks met for the first time are added."""
        get = self.rows.get
        new = [x for x in dict.fromkeys(found) if x not in self.rows]
        if new:
            ids, n, made = self.all_of(new, None)
            rows = self.store.add(ids, n)
            while self.store.rows > len(self.met):
                self.met = np.concatenate([self.met, np.zeros_like(self.met)])
            self.met[rows] = made
            self.rows.update(zip(new, rows.tolist()))
            self.chars += sum(map(len, new))
        return np.fromiter(map(get, found), np.int64, len(found))

    def ids_of(self, found: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids in each) of each occurrence of a chunk, whose candidates are skipped by its own key.

        Only what a chunk gives without skips is cached, bounded by characters and ids: an occurrence that skips none of those
        candidates has that; each other one is segmented by its own draws.
        """
        if self.store.used > self.cache_ids or self.chars > self.cache_chars:
            self.forget()
        rows = self.plainly(found)
        start, n = self.store.start[rows], self.store.n[rows]
        if not self.drop:
            return self.store.ids[_spread(start, n)], n
        met = self.met[rows]
        row = np.repeat(np.arange(len(rows)), met)
        hit = _mix(keys[row] + _spread(np.ones_like(met), met).astype(np.uint64) * _G2) < self.limit
        some = np.zeros(len(rows), bool)
        some[row[hit]] = True
        at = np.flatnonzero(some)
        if not len(at):
            return self.store.ids[_spread(start, n)], n
        varied, m, _ = self.all_of([found[k] for k in at.tolist()], keys[at])
        plain = n[~some]
        n[at] = m
        out = np.zeros(n.sum(), np.int32)
        to = np.cumsum(n) - n
        out[_spread(to[at], m)] = varied
        out[_spread(to[~some], plain)] = self.store.ids[_spread(start[~some], plain)]
        return out, n

    def encode(self, text: str, key: int = 0) -> list[int]:
        """Candidate merges are skipped by key and the chunk's place. A literal U+2581 becomes bytes, so decoding is lossless."""
        return self.encode_all([text], [key])[0].tolist()

    def encode_all(self, texts: list[str], keys: list[int], at_once: int = 32_768) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids in each) of texts with their keys; so many chunks are met together."""
        found: list[str] = []
        ends = []
        for text in texts:
            for k, part in enumerate(text.split("▁") if text else ()):
                if k:
                    found.append("")
                found += _CHUNKS.findall(("" if k else "▁") + part.replace(" ", "▁"))
            ends.append(len(found))
        n = np.diff(ends, prepend=0)
        place = _spread(np.zeros_like(n), n).astype(np.uint64)
        own = _mix(np.repeat(np.array([k & (2**64 - 1) for k in keys], np.uint64), n) + (place + np.uint64(1)) * _G1)
        parts = [self.ids_of(found[a : a + at_once], own[a : a + at_once]) for a in range(0, len(found), at_once)]
        ids, each = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        upto = np.concatenate([[0], np.cumsum(each)])
        return ids, np.diff(upto[np.concatenate([[0], ends]).astype(np.int64)])

    def decode(self, ids) -> str:
        return self.decode_all(np.asarray(ids, np.int64), np.array([len(ids)]))[0].decode("utf-8", "surrogatepass")

    def decode_all(self, ids: np.ndarray, n: np.ndarray) -> list[bytes]:
        """The UTF-8 texts of runs of n ids; the space before the first word goes."""
        long = self.plain_n[ids]
        data = self.plain[_spread(self.plain_start[ids], long)].tobytes()
        ends = np.concatenate([[0], np.cumsum(long)])[np.concatenate([[0], np.cumsum(n)])].tolist()
        return [data[a + 1 : b] for a, b in zip(ends, ends[1:])]


def _shared(model: str, dropout: float, seed: int) -> Pieces:
    """One encoder for a worker, so that its tasks share the chunks met before."""
    return kept(("pieces", model, dropout, seed), lambda: Pieces(model, dropout, seed))


def _groups(sizes: list[int], most: int = 400_000):
    """Bounds of runs of texts of about so many bytes."""
    a = 0
    while a < len(sizes):
        b, size = a + 1, sizes[a]
        while b < len(sizes) and (size := size + sizes[b]) <= most:
            b += 1
        yield a, b
        a = b


def encode(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, dropout: float = 0.1, seed: int = 1) -> DataFrame:
    """id, n_tokens, ids, lossless for every row; lossless says that decoding gives the text back.

    Each candidate merge is skipped by a hash of seed, id, the chunk's place and the candidate's number, so
    reruns agree and occurrences of a word are segmented independently. Null texts count as empty and have
    no ids; a null id is a key like any other; rows that repeat id and text repeat their result. Texts are
    encoded whole, of any length. An empty table gives an empty one; other columns aren't read.
    """

    def run(batches):
        p = _shared(model, dropout, seed)
        try:
            for b in batches:
                keys = [xxhash.xxh3_64_intdigest(str(k), seed) for k in b.column(0).to_pylist()]
                for x, y in _groups(pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist()):
                    texts = [t or "" for t in b.column(1).slice(x, y - x).to_pylist()]
                    ids, n = p.encode_all(texts, keys[x:y])
                    same = [got == t.encode("utf-8", "surrogatepass") for got, t in zip(p.decode_all(ids, n), texts)]
                    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.array(same, pa.bool_())], names=[id_col, "n_tokens", "ids", "lossless"])
        finally:  # the worker lives on, idle or in another stage
            p.forget()
            give_back()

    return documents.select(id_col, F.col(text_col).alias("__text")).mapInArrow(run, f"`{id_col}` {documents.schema[id_col].dataType.simpleString()}, n_tokens long, ids array<int>, lossless boolean")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """id, text for every row of encode()'s result; a null or empty list gives an empty text, an id outside the model raises."""

    def run(batches):
        p = _shared(model, 0.0, 0)
        for b in batches:
            lists = [x.as_py() or [] for x in b.column(1)]
            n = np.array([len(x) for x in lists], np.int64)
            ids = np.array([y for x in lists for y in x], np.int64)
            if len(ids) and not 0 <= ids.min() <= ids.max() < p.n_pieces:
                raise ValueError("an id stands for no piece")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.decode("utf-8", "replace") for x in p.decode_all(ids, n)], pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, F.col(ids_col).alias("__ids")).mapInArrow(run, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, text string")
