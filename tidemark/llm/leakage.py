"""Evaluation texts that leaked into a corpus (problem 9), by latent semantic retrieval.

Passages are windows of ``2 * RUN`` words every ``RUN`` words, so any run of ``RUN`` words lies whole in one. Passages are
TF-IDF vectors over the words of the evaluation items (inverse document frequencies are counted over all documents);
words outside that vocabulary only add to a passage's norm. A randomised SVD of the item passages stacked with a bounded
sample of corpus passages gives the latent basis: the sample's part of the range sketch is summed by the executors.
Every passage of every document is projected; passages whose cosine with an item passage reaches ``COSINE`` are
candidates. Candidates are then checked: the longest run of equal words, the longest common subsequence, and whether
the item's last words (its answer) are there.

Two bounds skip work without losing candidates: a cosine in the latent space is at most the share of a passage's norm
that lies in the vocabulary, and at most the share that the projection keeps.

Items are a query set of any number. They are streamed to the driver in groups of at most ``GROUP_WORDS`` words; a group costs
three passes over the documents (word counts, sketch of a sample, search), and what it broadcasts is bounded. Inside a group
every ``BLOCK_PASSAGES`` passages have a latent basis of their own, whose rank grows until each of them keeps ``KEPT`` of its
length, so that recall doesn't fall as items are added. A basis is fitted on the items and about ``FIT_DOCS`` documents;
all documents are counted and searched. The sketch and the products are sparse: only rows of words that occur are added up.

Defined results: null and empty texts have no passages; null keys have no rows; texts shorter than a run share none;
documents and items that occur twice count once.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrow import arrow_map

RUN = 13
#: Least rank of a basis, and the share of each item passage's length that a basis has to keep.
RANK, KEPT = 96, 0.5
COSINE = 0.22
FIT_DOCS = 4000
#: Passages of items that share a basis, and words of the items searched for in one pass.
BLOCK_PASSAGES, GROUP_WORDS = 1200, 100_000
#: Columns of the corpus' part of the sketch.
SKETCH = 112
OUTSIDE = 2.0
#: Least weight of a word of the items, so that an item leaked into most documents is still found.
LEAST_IDF = 1.0
SEED = 9

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def windows(n: int) -> np.ndarray:
    """Starts of the passages of a text of ``n`` words."""
    return np.arange(0, max(n - RUN, 0) + 1, RUN) if n else np.zeros(0, np.int64)


#: Set between the texts of a batch, where it is no part of a text.
_STOP = "\x00"
_WORD_OR_STOP = re.compile(r"[^\W_]+|\x00")


class Items:
    """Evaluation items: vocabulary, passages and runs."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids, self.texts = [r[0] for r in rows], [words(r[1]) for r in rows]
        self.vocab = {w: k for k, w in enumerate(dict.fromkeys(w for t in self.texts for w in t))}
        self.coded = [np.array([self.vocab[w] for w in t], np.int64) for t in self.texts]
        self.runs = [{tuple(c[k : k + RUN].tolist()) for k in range(len(c) - RUN + 1)} for c in self.coded]
        self.places = [_places(c.tolist()) for c in self.coded]
        self.passages = [(i, c[s : s + 2 * RUN]) for i, c in enumerate(self.coded) for s in windows(len(c))]


def _places(coded: list[int]) -> dict[int, tuple[int, ...]]:
    """Where each word stands in an item."""
    out = defaultdict(list)
    for k, w in enumerate(coded):
        out[w].append(k)
    return {w: tuple(ks) for w, ks in out.items()}


def passage_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, *values.shape[1:]), np.float64), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[ends] - total[starts]


class Basis:
    """Latent basis of some item passages. ``words`` are the group's codes of its vocabulary, ``queries`` the projected passages (unit length)."""

    def __init__(self, owner: np.ndarray, passages: list[np.ndarray], own: np.ndarray, idf: np.ndarray, vectors: np.ndarray):
        self.owner, self.words = owner, own
        self.matrix = np.vstack([idf[own, None] * vectors, np.zeros((1, vectors.shape[1]))]).astype(np.float32)  # last row: outside words
        self.inside2 = np.append(idf[own] ** 2, 0.0)
        self.weight2 = np.append(idf[own] ** 2, OUTSIDE**2)
        norm = np.array([np.sqrt(_norm2(c, self.weight2)) for c in passages])
        self.least_norm = float(norm.min())
        low = np.stack([self.matrix[c].sum(axis=0) for c in passages])
        self.queries = (low / np.maximum(norm[:, None], 1e-9)).astype(np.float32)

    def code(self, coded: np.ndarray, n_words: int) -> np.ndarray:
        """Codes of the group as codes of this vocabulary."""
        to = np.full(n_words + 1, len(self.words), np.int64)
        to[self.words] = np.arange(len(self.words))
        return to[coded]


class Group:
    """Items searched for in one pass, with their bases."""

    def __init__(self, items: Items, bases: list[Basis]):
        self.items, self.bases = items, bases


def _norm2(coded: np.ndarray, weight2: np.ndarray) -> float:
    """Squared TF-IDF norm of one passage, with raw term frequencies."""
    u, n = np.unique(coded, return_counts=True)
    return float((n.astype(np.float64) ** 2 * weight2[u]).sum())


def code(texts: list[str | None], vocab: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(word codes of all texts in a row, number of words of each); outside words are ``len(vocab)``."""
    found = _WORD_OR_STOP.findall(_STOP.join((t or "").replace(_STOP, " ") for t in texts).lower())
    codes = np.fromiter(map((vocab | {_STOP: -1}).get, found, repeat(len(vocab))), np.int64, len(found))
    stops = np.flatnonzero(codes == -1)
    edge = np.concatenate([[-1], stops, [len(found)]])
    return codes[codes != -1], np.diff(edge) - 1


def layout(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (in the flat codes) and text of every passage."""
    count = np.where(n > 0, np.maximum(n - RUN, 0) // RUN + 1, 0)
    base = np.cumsum(n) - n
    text = np.repeat(np.arange(len(n)), count)
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    start = base[text] + nth * RUN
    return start, np.minimum(start + 2 * RUN, (base + n)[text]), text


def candidates(coded: np.ndarray, n: np.ndarray, b: Basis):
    """(text, start, end, item) of passage pairs whose cosine reaches the threshold."""
    start, end, text = layout(n)
    if not len(start):
        return []
    # norms with term frequencies taken as 1 each; repeated words only make the true norm larger, so nothing is lost
    inside = passage_sums(b.inside2[coded], start, end)
    norm2 = passage_sums(b.weight2[coded], start, end)
    keep = inside >= (COSINE**2) * norm2 * 0.999
    # and of its own words a passage must bring as much as the cosine asks of the shortest item passage
    keep &= inside >= COSINE * np.sqrt(norm2) * b.least_norm
    if not keep.any():
        return []
    start, end, text, norm = start[keep], end[keep], text[keep], np.sqrt(norm2[keep])
    # only words of the vocabulary are projected; every passage left has some
    size = end - start
    word = coded[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    known = word < len(b.words)
    first = np.concatenate([[0], np.cumsum(np.add.reduceat(known, np.cumsum(size) - size, dtype=np.int64))[:-1]])
    low = np.add.reduceat(b.matrix[word[known]], first, axis=0)
    near = np.linalg.norm(low, axis=1) >= COSINE * norm * 0.999
    out = []
    for k in np.array_split(np.flatnonzero(near), max(1, int(near.sum()) // 2000)):
        if len(k):
            cos = (low[k] @ b.queries.T) / norm[k][:, None]
            rows, cols = np.nonzero(cos >= COSINE)
            out += list(zip(text[k][rows].tolist(), start[k][rows].tolist(), end[k][rows].tolist(), b.owner[cols].tolist()))
    return list(dict.fromkeys(out))


def longest_run(words_: list[int], places: dict[int, tuple[int, ...]]) -> int:
    """Length of the longest run of equal words: only the places where a word stands in the item are looked at."""
    best, last = 0, {}
    for x in words_:
        last = {k: last.get(k - 1, 0) + 1 for k in places.get(x, ())}
        if last:
            best = max(best, *last.values())
    return best


def common_subsequence(words_: list[int], places: dict[int, tuple[int, ...]], size: int) -> int:
    """Length of the longest common subsequence with an item of ``size`` words, all of its places as bits of one number."""
    full = (1 << size) - 1
    s = full
    for x in words_:
        at = places.get(x)
        if at:
            u = s & sum(1 << k for k in at)
            s = ((s + u) | (s - u)) & full
    return size - s.bit_count()


def _document_frequencies(documents: DataFrame, items: Items, text: str) -> tuple[np.ndarray, int]:
    """Documents holding each word of the vocabulary, over all documents; the number of documents."""
    vocab = items.vocab
    held = documents.sparkSession.sparkContext.broadcast(vocab)

    def run(b: pa.RecordBatch):
        v = held.value
        c, known = np.zeros(len(v) + 1, np.int64), v.keys()
        for t in b["t"].to_pylist():
            found = set(_WORD.findall(t.lower()))
            if found:
                c[len(v)] += 1  # the last slot counts the documents
                for w in known & found:
                    c[v[w]] += 1
        k = np.flatnonzero(c)
        return {"w": k, "n": c[k]}

    rows = arrow_map(documents.select(F.col(text).alias("t")).where("t is not null"), run, "w long, n long", rows=2000).groupBy("w").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(len(vocab) + 1, np.int64)  # at most one row per word of the items
    for r in rows:
        df[r.w] = r.n
    return df[:-1], int(df[-1])


def _sketch(n_words: int, idf: np.ndarray, omega: np.ndarray, coded: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """This batch's part of A'A Omega: the words that occur and their rows."""
    start, end, _ = layout(n)
    none = np.zeros(0, np.int64), np.zeros((0, omega.shape[1]))
    if not len(start):
        return none
    size = end - start
    at = coded[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    rows = np.repeat(np.arange(len(size)), size)
    known = at < n_words
    at, rows = at[known], rows[known]
    if not len(at):
        return none
    # passages with words of the items, in order; each is projected once
    first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    low = np.add.reduceat(idf[at, None] * omega[at], first, axis=0)
    rows = np.cumsum(np.append(False, rows[1:] != rows[:-1]))
    order = np.argsort(at, kind="stable")
    codes, rows = at[order], rows[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    return codes[first], np.add.reduceat(low[rows], first, axis=0) * idf[codes[first], None]


def item_groups(eval_items: DataFrame, group_words: int) -> Iterator[Items]:
    """The items in groups of at most ``group_words`` words (a longer item stands alone), streamed in the order of their ids."""
    rows, size = [], 0
    for r in eval_items.where("item_id is not null and text is not null").select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        n = len(words(r.text))
        if rows and size + n > group_words:
            yield Items(rows)
            rows, size = [], 0
        rows.append((r.item_id, r.text))
        size += n
    if rows:
        yield Items(rows)


def _basis(passages: list[tuple[int, np.ndarray]], idf: np.ndarray, corpus: np.ndarray) -> Basis:
    """Randomised SVD of these passages, its range widened by the corpus' sketch; the rank doubles until every passage is kept."""
    own = np.unique(np.concatenate([c for _, c in passages]))
    at = {w: k for k, w in enumerate(own.tolist())}
    local = [np.array([at[w] for w in c.tolist()], np.int64) for _, c in passages]
    flat, n = np.concatenate(local), np.array([len(c) for c in local])
    weight = idf[own]
    norm = np.sqrt(np.array([_norm2(c, np.append(weight**2, 0.0)) for c in local]))
    most = min(len(own), len(local) + SKETCH)
    rank = min(RANK, most)
    while True:
        size = min(rank + 16, len(own))
        omega = np.random.default_rng(SEED).standard_normal((len(own), size))
        y = np.zeros((len(own), size))
        w, rows = _sketch(len(own), weight, omega, flat, n)
        y[w] = rows
        # the corpus' part weighs as much as the items' own in the columns it has
        c = corpus[own]
        both = y / max(np.linalg.norm(y), 1e-9)
        k = min(c.shape[1], size)
        both[:, :k] += c[:, :k] / max(np.linalg.norm(c), 1e-9)
        q, _ = np.linalg.qr(both)
        low = np.stack([(weight[c, None] * q[c]).sum(axis=0) for c in local])  # A q, without ever writing A out
        _, vectors = np.linalg.eigh(low.T @ low)  # its right singular vectors, the greatest last
        vectors = q @ vectors[:, ::-1][:, :rank]
        kept = np.linalg.norm(np.stack([(weight[c, None] * vectors[c]).sum(axis=0) for c in local]), axis=1)
        if rank >= most or (kept >= KEPT * norm).all():
            return Basis(np.array([i for i, _ in passages], np.int64), local, own, idf, vectors)
        rank = min(2 * rank, most)


def fit(documents: DataFrame, items: Items, key: str = "doc_id", text: str = "text") -> Group | None:
    """Bases of one group of items; None where no item has a word."""
    if not items.passages:
        return None
    df, n_docs = _document_frequencies(documents, items, text)
    idf = np.maximum(np.log((1 + n_docs) / (1 + df)), LEAST_IDF)
    held = documents.sparkSession.sparkContext.broadcast((items.vocab, idf))  # bounded by the group's words
    sample = documents
    if n_docs > FIT_DOCS:  # a threshold on the whole 64-bit hash: as fine as the corpus is large
        sample = documents.where(F.xxhash64(F.col(key), F.lit(SEED)) < F.lit(int(FIT_DOCS / n_docs * 2**64) - 2**63))
    schema = pa.schema([("w", pa.int64()), ("y", pa.binary())])

    def added(parts: Iterator[tuple[np.ndarray, np.ndarray]]):
        """Sum of sparse rows, as one batch."""
        at: dict[int, int] = {}
        total: list[np.ndarray] = []
        for w, y in parts:
            for k, row in zip(w.tolist(), y):
                if k in at:
                    total[at[k]] += row
                else:
                    at[k] = len(total)
                    total.append(row.astype(np.float64))
        if total:
            yield pa.RecordBatch.from_pydict({"w": list(at), "y": [x.astype(np.float32).tobytes() for x in total]}, schema=schema)

    def sketch(batches):
        vocab, idf_ = held.value
        omega = np.random.default_rng(SEED).standard_normal((len(idf_), SKETCH), np.float32)  # the same in every task
        return added(_sketch(len(idf_), idf_, omega, *code(b["t"].to_pylist(), vocab)) for b in batches)

    def add(batches):
        return added((b["w"].to_numpy(), np.stack([np.frombuffer(y, np.float32) for y in b["y"].to_pylist()])) for b in batches if b.num_rows)

    parts = sample.select(F.col(text).alias("t")).where("t is not null").mapInArrow(sketch, "w long, y binary")
    corpus = np.zeros((len(idf), SKETCH), np.float32)
    for r in parts.repartition(4, "w").mapInArrow(add, "w long, y binary").collect():  # one row per word of the group that the sample holds
        corpus[r.w] = np.frombuffer(r.y, np.float32)
    held.unpersist()
    return Group(items, [_basis(items.passages[k : k + BLOCK_PASSAGES], idf, corpus) for k in range(0, len(items.passages), BLOCK_PASSAGES)])


def _checked(documents: DataFrame, eval_items: DataFrame, key: str, text: str, full: bool, group_words: int) -> DataFrame:
    """Candidates of every group of items with their checks."""
    spark = documents.sparkSession
    schema = f"doc_id {dict(documents.dtypes)[key]}, item_id long, run_words int, lcs_words int, item_words int, answered boolean"
    groups = (fit(documents, items, key, text) for items in item_groups(eval_items, group_words))
    found = [_search(documents, spark.sparkContext.broadcast(g), schema, key, text, full) for g in groups if g is not None]
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], schema)


def _search(documents: DataFrame, held, schema: str, key: str, text: str, full: bool) -> DataFrame:

    def run(b: pa.RecordBatch):
        m = held.value
        coded, n = code(b["t"].to_pylist(), m.items.vocab)
        best: dict[tuple[int, int], list[int]] = {}
        for t, s, e, i in (x for basis in m.bases for x in candidates(basis.code(coded, len(m.items.vocab)), n, basis)):
            w = coded[s:e].tolist()
            if full:
                c, places = m.items.coded[i], m.items.places[i]
                r, lcs = longest_run(w, places), common_subsequence(w, places, len(c))
                answered = set(c[-3:].tolist()) <= set(w)
                old = best.get((t, i), [0, 0, False])
                best[t, i] = [max(old[0], r), max(old[1], lcs), old[2] or answered]
            elif any(tuple(w[k : k + RUN]) in m.items.runs[i] for k in range(len(w) - RUN + 1)):
                best[t, i] = [RUN, RUN, False]
        if not best:
            return None
        rows = list(best)
        return {
            "doc_id": b["k"].take(pa.array([t for t, _ in rows])), "item_id": [m.items.ids[i] for _, i in rows], "run_words": [best[r][0] for r in rows],
            "lcs_words": [best[r][1] for r in rows], "item_words": [len(m.items.coded[i]) for _, i in rows], "answered": [best[r][2] for r in rows],
        }

    return arrow_map(documents.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null and k is not null"), run, schema, rows=200)


def p9_found(documents: DataFrame, eval_items: DataFrame, key: str = "doc_id", text: str = "text", group_words: int = GROUP_WORDS) -> DataFrame:
    """(doc_id, item_id) of documents and items that share at least ``RUN`` consecutive words."""
    return _checked(documents, eval_items, key, text, False, group_words).select("doc_id", "item_id").distinct()


def p9_report(documents: DataFrame, eval_items: DataFrame, least: int = 10, key: str = "doc_id", text: str = "text", group_words: int = GROUP_WORDS) -> DataFrame:
    """Every candidate whose longest common subsequence within a passage has at least ``least`` words, paraphrases included."""
    return _checked(documents, eval_items, key, text, True, group_words).where(F.col("lcs_words") >= least).distinct()
