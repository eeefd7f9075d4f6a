"""Byte-pair encoding with a public vocabulary: token budgets (problem 4) and token ids (problem 8).

Texts are cut into pieces by the vocabulary's pattern; equal pieces are worked out once per worker (bounded caches).

* ``count_symbols`` keeps a piece as a linked list of symbols with a priority queue of merges and counts the symbols that
  survive; ``p4_*`` weights the counts by how often a piece stands in a document and rolls up exact sums.
* ``encode_pieces`` holds a segment tree over the byte positions of each piece whose root is the leftmost least pair
  rank; a merge updates the three leaves it touches on their way up. The trees of many pieces are advanced together in
  numpy, by size class.

Defined results: null and empty texts have no tokens: 0 in budgets, an empty list of ids. Strings of special tokens are
ordinary text. Vocabulary files are read from the installed package of public tokenizers, or from ``path``.
"""

from __future__ import annotations

import base64
import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrow import arrow_map

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Distinct pieces a worker remembers, and the longest of them in characters (longer ones are worked out each time), so about
#: 100 MB at most; when full, the cache starts anew.
CACHE, LONGEST = 300_000, 64
#: Pieces of more bytes have all places of a rank merged at once.
LONG = 256
INF = np.int64(2**62)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Vocabulary:
    """Ranks of byte strings, and the rank of merging two neighbouring symbols."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        # pairs of symbols that can meet: every split of a merged string into two known strings
        keys, merged = [], []
        for text, rank in self.ranks.items():
            for k in range(1, len(text)):
                a, b = self.ranks.get(text[:k]), self.ranks.get(text[k:])
                if a is not None and b is not None:
                    keys.append((a << 20) | b)
                    merged.append(rank)
        keys = np.array(keys, np.uint64)
        self.bits = int(np.ceil(np.log2(len(keys) * 4)))
        self.slot = np.full(1 << self.bits, np.uint64(2**63), np.uint64)
        self.value = np.full(1 << self.bits, -1, np.int64)
        todo, at = np.arange(len(keys)), self._at(keys)
        while len(todo):
            free = self.slot[at] == np.uint64(2**63)
            _, first = np.unique(at[free], return_index=True)
            win = np.flatnonzero(free)[first]
            self.slot[at[win]] = keys[todo[win]]
            self.value[at[win]] = np.array(merged)[todo[win]]
            left = np.ones(len(todo), bool)
            left[win] = False
            todo, at = todo[left], (at[left] + 1) & ((1 << self.bits) - 1)
        self.pairs = dict(zip(keys.tolist(), merged))

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of merging symbols ``a`` and ``b``; INF where they don't merge (or one is -1)."""
        key = (a.astype(np.uint64) << np.uint64(20)) | (b.astype(np.uint64) & np.uint64(0xFFFFF))
        at = self._at(key)
        bad = np.flatnonzero((self.slot[at] != key) & (self.slot[at] != np.uint64(2**63)))
        while len(bad):
            at[bad] = (at[bad] + 1) & ((1 << self.bits) - 1)
            bad = bad[(self.slot[at[bad]] != key[bad]) & (self.slot[at[bad]] != np.uint64(2**63))]
        hit = (self.slot[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.value[at], INF)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=1)
def splitter():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


_BESIDE = tuple(a + b for a in " \n\r\t" for b in " \n\r\t" if " " in (a, b))
_OTHER_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_LONE_BLANK = re.compile(r"(?<=\S)(?= \S)")


def chunks(text: str) -> list[str]:
    """Cut a text at its lone blanks, each going with what follows; no piece of the pattern reaches over such a cut.

    Chunks are the unit of the caches: most are single words. A blank beside other white space, where the pattern looks
    over the blank, is no place to cut.
    """
    if any(x in text for x in _BESIDE) or not text.isascii() and _OTHER_SPACE.search(text):
        return _LONE_BLANK.split(text)
    first, *rest = text.split(" ")
    return [first, *(" " + x for x in rest)] if first else [" " + x for x in rest]


def count_symbols(piece: bytes, v: Vocabulary) -> int:
    """Symbols of ``piece`` that survive all merges: linked list and priority queue."""
    n = len(piece)
    if n < 2 or piece in v.ranks:
        return 1 if n else 0
    sym = [int(v.byte[x]) for x in piece]
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    pairs = v.pairs
    heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := pairs.get((sym[i] << 20) | sym[i + 1])) is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = nxt[i]
        if sym[i] != a or j >= n or sym[j] != b:
            continue  # one of the two was merged since
        sym[i], sym[j] = rank, -1
        nxt[i] = k = nxt[j]
        left -= 1
        if k < n:
            prv[k] = i
            if (r := pairs.get((rank << 20) | sym[k])) is not None:
                heapq.heappush(heap, (r, i, rank, sym[k]))
        if (p := prv[i]) >= 0 and (r := pairs.get((sym[p] << 20) | rank)) is not None:
            heapq.heappush(heap, (r, p, sym[p], rank))
    return left


def _encode_class(rows: list[bytes], size: int, v: Vocabulary) -> list[np.ndarray]:
    """Ids of pieces of at most ``size`` bytes (a power of two): one segment tree each, advanced together."""
    n = len(rows)
    length = np.array([len(r) for r in rows])
    raw = np.zeros((n, size), np.uint8)
    inside = np.arange(size)[None, :] < length[:, None]
    raw[inside] = np.frombuffer(b"".join(rows), np.uint8)
    sym = np.where(inside, v.byte[raw], -1)
    pos = np.arange(size)
    nxt, prv = np.tile(pos + 1, (n, 1)), np.tile(pos - 1, (n, 1))
    tree = np.full((n, 2 * size), INF, np.int64)
    if size > 1:
        r = v.rank_of(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(n, size - 1)
        tree[:, size : 2 * size - 1] = np.where(r < INF, r * size + pos[None, :-1], INF)
    level = size // 2
    while level:
        kids = tree[:, 2 * level : 4 * level]
        tree[:, level : 2 * level] = np.minimum(kids[:, 0::2], kids[:, 1::2])
        level //= 2
    live = np.flatnonzero(tree[:, 1] < INF)
    while len(live):
        top = tree[live, 1]
        rank, i = top // size, top % size
        j = nxt[live, i]
        k = nxt[live, j]
        p = prv[live, i]
        sym[live, i] = rank
        sym[live, j] = -1
        nxt[live, i] = k
        has_k, has_p = k < length[live], p >= 0
        prv[live[has_k], k[has_k]] = i[has_k]
        after = np.where(has_k, sym[live, np.minimum(k, size - 1)], -1)
        before = np.where(has_p, sym[live, np.maximum(p, 0)], -1)
        r1 = v.rank_of(rank, after)
        r0 = v.rank_of(before, rank)
        tree[live, size + i] = np.where(r1 < INF, r1 * size + i, INF)
        tree[live, size + j] = INF
        q, ph = live[has_p], p[has_p]
        tree[q, size + ph] = np.where(r0[has_p] < INF, r0[has_p] * size + ph, INF)
        for rows_, leaf in ((live, i), (live, j), (q, ph)):
            node = (size + leaf) // 2
            for _ in range(size.bit_length() - 1):
                tree[rows_, node] = np.minimum(tree[rows_, 2 * node], tree[rows_, 2 * node + 1])
                node = node // 2
        live = live[tree[live, 1] < INF]
    return [s[s >= 0] for s in sym]


def _encode_long(rows: list[bytes], size: int, v: Vocabulary) -> list[np.ndarray]:
    """``_encode_class`` for long pieces: every place of the root's rank is merged at once, found by going down the tree.

    That is the order of one merge after another as long as no pair that arises ranks below the one merged; in a tree where
    one does, the merge is taken back and only the leftmost place is merged.
    """
    n = len(rows)
    length = np.array([len(r) for r in rows])
    raw = np.zeros((n, size), np.uint8)
    inside = np.arange(size)[None, :] < length[:, None]
    raw[inside] = np.frombuffer(b"".join(rows), np.uint8)
    sym = np.where(inside, v.byte[raw], -1)
    pos = np.arange(size)
    nxt, prv = np.tile(pos + 1, (n, 1)), np.tile(pos - 1, (n, 1))
    tree = np.full((n, 2 * size), INF, np.int64)
    tree[:, size : 2 * size - 1] = v.rank_of(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(n, size - 1)
    level = size // 2
    while level:
        kids = tree[:, 2 * level : 4 * level]
        tree[:, level : 2 * level] = np.minimum(kids[:, 0::2], kids[:, 1::2])
        level //= 2

    def pairs(t, i):
        """(rank of i with its right neighbour, left neighbour, rank with that)."""
        k, p = nxt[t, i], prv[t, i]
        after = np.where(k < length[t], sym[t, np.minimum(k, size - 1)], -1)
        before = np.where(p >= 0, sym[t, np.maximum(p, 0)], -1)
        return v.rank_of(sym[t, i], after), p, v.rank_of(before, sym[t, i])

    def merge(t, i, rank):
        j = nxt[t, i]
        k = nxt[t, j]
        old = (t, i, j, k, sym[t, i], sym[t, j])
        sym[t, i], sym[t, j] = rank, -1
        nxt[t, i] = k
        has = k < length[t]
        prv[t[has], k[has]] = i[has]
        return old

    live = np.flatnonzero(tree[:, 1] < INF)
    while len(live):
        least = tree[:, 1]
        t, node = live, np.ones(len(live), np.int64)
        while node[0] < size:  # all nodes are of one level
            t, node = np.repeat(t, 2), np.stack([2 * node, 2 * node + 1], 1).ravel()
            keep = tree[t, node] == least[t]
            t, node = t[keep], node[keep]
        i = node - size
        # of places side by side (as in a run of one letter) every other one, from the left
        fresh = np.append(True, (t[1:] != t[:-1]) | (nxt[t[:-1], i[:-1]] != i[1:]))
        at = np.arange(len(t))
        take = (at - np.maximum.accumulate(np.where(fresh, at, 0))) % 2 == 0
        t, i = t[take], i[take]
        rank = least[t]
        t_, i_, j, k, sym_i, sym_j = merge(t, i, rank)
        r1, p, r0 = pairs(t, i)
        bad = np.zeros(n, bool)
        bad[t[(r1 < rank) | (r0 < rank)]] = True
        if bad.any():
            b = bad[t]
            tb, ib, jb, kb = t[b], i[b], j[b], k[b]
            sym[tb, ib], sym[tb, jb] = sym_i[b], sym_j[b]
            nxt[tb, ib] = jb
            has = kb < length[tb]
            prv[tb[has], kb[has]] = jb[has]
            one = ~b | np.append(True, t[1:] != t[:-1])
            redo = b & one
            merge(t[redo], i[redo], rank[redo])
            t, i, j = t[one], i[one], j[one]
            r1, p, r0 = pairs(t, i)
        tree[t, size + i] = r1
        tree[t, size + j] = INF
        left = p >= 0
        tree[t[left], size + p[left]] = r0[left]
        touched = np.unique(np.concatenate([t * (2 * size) + size + i, t * (2 * size) + size + j, (t * (2 * size) + size + p)[left]]))
        t, node = touched // (2 * size), touched % (2 * size)
        for _ in range(size.bit_length() - 1):
            up = np.unique(t * (2 * size) + node // 2)
            t, node = up // (2 * size), up % (2 * size)
            tree[t, node] = np.minimum(tree[t, 2 * node], tree[t, 2 * node + 1])
        live = live[tree[live, 1] < INF]
    return [s[s >= 0] for s in sym]


def encode_pieces(pieces: list[bytes], v: Vocabulary, at_once: int = 2_000_000) -> list[np.ndarray]:
    """Ids of each piece."""
    out: list = [None] * len(pieces)
    classes: dict[int, list[int]] = {}
    for i, p in enumerate(pieces):
        known = v.ranks.get(p)
        if known is not None:
            out[i] = np.array([known])
        elif not p:
            out[i] = np.zeros(0, np.int64)
        else:
            classes.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(i)
    for size, rows in classes.items():
        step = max(1, at_once // size)
        encode = _encode_class if size <= LONG else _encode_long
        for k in range(0, len(rows), step):
            for i, ids in zip(rows[k : k + step], encode([pieces[i] for i in rows[k : k + step]], size, v)):
                out[i] = ids
    return out


class _Store:
    """A growing array: appending copies the whole only when it doubles."""

    def __init__(self, kind):
        self.data, self.n = np.zeros(1024, kind), 0

    def add(self, values: np.ndarray):
        end = self.n + len(values)
        if end > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.zeros(max(len(self.data), end), self.data.dtype)])
        self.data[self.n : end] = values
        self.n = end


class Encoder:
    """Encodes batches of texts; remembers the ids of distinct chunks in one growing store."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.reset()

    def reset(self):
        self.index: dict[str, int] = {}
        self.pieces: dict[str, np.ndarray] = {}
        self.flat, self.start, self.size = _Store(np.int32), _Store(np.int64), _Store(np.int64)

    def _learn(self, new: list[str]):
        split = splitter().findall
        per = [split(c) for c in new]
        missing = [p for p in dict.fromkeys(p for ps in per for p in ps) if p not in self.pieces]
        got = dict(zip(missing, encode_pieces([p.encode("utf-8", "replace") for p in missing], self.v)))
        ids = [np.concatenate([got[p] if p in got else self.pieces[p] for p in ps]) if ps else np.zeros(0, np.int64) for ps in per]
        self.pieces.update((p, x) for p, x in got.items() if len(p) <= LONGEST)
        self.index.update(zip(new, range(self.start.n, self.start.n + len(new))))
        size = np.array([len(x) for x in ids], np.int64)
        self.start.add(self.flat.n + np.cumsum(size) - size)
        self.size.add(size)
        self.flat.add(np.concatenate(ids) if ids else size)

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        if len(self.index) + len(self.pieces) > CACHE:
            self.reset()
        per = [chunks(t) if t else [] for t in texts]
        every = [c for cs in per for c in cs]
        new = set(every) - self.index.keys()
        self._learn([c for c in new if len(c) <= LONGEST])
        kept = self.start.n, self.flat.n
        long = [c for c in new if len(c) > LONGEST]
        self._learn(long)
        at = np.fromiter(map(self.index.__getitem__, every), np.int64, len(every))
        size = self.size.data[at]
        total = int(size.sum())
        where = np.repeat(self.start.data[at] - (np.cumsum(size) - size), size) + np.arange(total)
        per_text = np.repeat(np.arange(len(texts)), [len(c) for c in per])
        ids = self.flat.data[where]
        for c in long:  # long chunks are forgotten again
            del self.index[c]
        self.start.n = self.size.n = kept[0]
        self.flat.n = kept[1]
        return ids, np.bincount(per_text, weights=size, minlength=len(texts)).astype(np.int64)


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(vocabulary(path))


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids): every row's text as token ids without special tokens."""
    path = path or vocabulary_path()
    kind = dict(df.dtypes)[key]

    def run(b: pa.RecordBatch):
        ids, n = _encoder(path).batch(b["__t"].to_pylist())
        offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        return {key: b[key], "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))}

    return arrow_map(df.select(key, F.col(text).alias("__t")), run, f"`{key}` {kind}, ids array<int>", rows=400)


class _Known(dict):
    """Number of tokens of a chunk, worked out when first asked for."""

    def __init__(self, v: Vocabulary):
        super().__init__()
        self.v, self.pieces = v, {}

    def __missing__(self, chunk: str) -> int:
        n = 0
        for p in splitter().findall(chunk):
            k = self.pieces.get(p)
            if k is None:
                k = count_symbols(p.encode("utf-8", "replace"), self.v)
                if len(p) <= LONGEST:
                    self.pieces[p] = k
            n += k
        if len(chunk) <= LONGEST:
            self[chunk] = n
        return n


@lru_cache(maxsize=2)
def _counter(path: str) -> _Known:
    return _Known(vocabulary(path))


def _counted(texts: list[str | None], known: _Known) -> list[int]:
    out = []
    for t in texts:
        if len(known) + len(known.pieces) > CACHE:
            known.clear()
            known.pieces.clear()
        out.append(sum(map(known.__getitem__, chunks(t))) if t else 0)
    return out


def token_counts(df: DataFrame, keep: list[str], text: str = "content", path: str | None = None) -> DataFrame:
    """``keep`` plus ``n_tokens`` of the text of every row."""
    path = path or vocabulary_path()
    kinds = dict(df.dtypes)

    def run(b: pa.RecordBatch):
        return {c: b[c] for c in keep} | {"n_tokens": _counted(b["__t"].to_pylist(), _counter(path))}

    return arrow_map(df.select(*keep, F.col(text).alias("__t")), run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n_tokens long")


def _copy_key(columns: list[str]) -> "F.Column":
    """128 bits of all the columns of a row, nulls told apart from empty texts."""
    of = [x for c in columns for x in (F.col(c).isNull(), F.coalesce(F.col(c), F.lit("")))]
    return F.struct(F.xxhash64(*of).alias("a"), F.xxhash64(F.lit(7), *of).alias("b"))


def p4_tokens(articles: DataFrame, path: str | None = None) -> DataFrame:
    """(id, n_tokens) of each article, once per id and content; two contents of one id give two rows, even of equal counts."""
    a = articles.where("id is not null").select("id", "content").withColumn("copy", _copy_key(["id", "content"]))
    return token_counts(a, ["id", "copy"], path=path).dropDuplicates(["id", "copy"]).select("id", "n_tokens")


def site_domain(url) -> "F.Column":
    """Host of a URL in lower case without ``www.``, credentials and port; a missing scheme is allowed."""
    host = F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(F.lower(host), r"^www\.", ""), F.lit(""))


def p4_budget(articles: DataFrame, path: str | None = None) -> DataFrame:
    """(slice, value, n_articles, n_tokens): exact totals by source_uri, language and domain; copies of a row count once."""
    a = articles.where("id is not null").select("id", "source_uri", "language", site_domain(F.col("url")).alias("domain"), "content")
    a = a.withColumn("copy", _copy_key(["id", "source_uri", "language", "domain", "content"]))
    # a copy is dropped by its hash, which moves instead of the text
    t = token_counts(a, ["source_uri", "language", "domain", "copy"], path=path).dropDuplicates(["copy"])
    slices = F.array(*[F.struct(F.lit(c).alias("slice"), F.col(c).alias("value")) for c in ("source_uri", "language", "domain")])
    return (
        t.select(F.explode(slices).alias("s"), "n_tokens").groupBy("s.slice", "s.value")
        .agg(F.count(F.lit(1)).alias("n_articles"), F.sum("n_tokens").alias("n_tokens"))
    )


def p8_ids(documents: DataFrame, path: str | None = None) -> DataFrame:
    return token_ids(documents, path=path)
