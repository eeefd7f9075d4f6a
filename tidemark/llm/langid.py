"""Language of documents and of the lines in them, by prediction by partial matching (problem 5).

One byte context tree of order ``ORDER`` per language is trained on clean samples. A symbol seen after its context costs
its frequency, one not seen there costs an escape (method C: distinct / (total + distinct)) and is looked up one order
lower, down to a uniform byte. After training the statistics are frozen: for every context and every n-gram of the union
of the trees the exact code length in each language is tabulated, so scoring a batch is one longest-match lookup per
byte and a sum per line, all in numpy. The language of a line is the one with the shortest code; lines of a document are
smoothed by a shortest path that pays ``SWITCH`` bits for each change of language, so that single short lines lean on
their neighbours. A document's main language holds most of its bytes.

``p5_found`` and ``p5_languages`` work on lines; ``p5_segments`` cuts lines at the ends of sentences as well and unites neighbours of
one language, so that a line of two languages comes out as two segments with their places.

Training takes at most ``MAX_SAMPLES`` labelled rows (lowest ids first), a documented bound; nothing else is sampled.
Defined results: null and blank contents have no rows; blank lines have no language; without samples there are no rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrow import arrow_map

ORDER = 4
SWITCH = 14.0
LEAST_BITS = 24.0
LEAST_RATE = 3.2
MAX_SAMPLES = 4000
# Spellings of the labels, by ISO 639-3 code.
SPELLINGS = {
    "eng": "eng en english", "spa": "spa es spanish español espanol castellano", "por": "por pt portuguese português portugues",
    "fra": "fra fre fr french français francais", "deu": "deu ger de german deutsch", "ita": "ita it italian italiano",
    "rus": "rus ru russian русский", "zho": "zho chi zh chinese mandarin cmn 中文 汉语",
}
SPELLED = {w: code for code, ws in SPELLINGS.items() for w in ws.split()}
PLACEHOLDERS = {"", "und", "unk", "unknown", "none", "null", "nan", "n/a", "na", "mis", "mul", "zxx", "-", "--", "?", "xx", "xxx", "other", "undefined", "undetermined"}


def label_code(label: str | None) -> str | None:
    """ISO 639-3 code a label spells; None for missing and placeholders; the label itself where it's another language."""
    x = (label or "").strip().lower()
    if x in PLACEHOLDERS:
        return None
    if x in SPELLED:
        return SPELLED[x]
    base = x.replace("_", "-").split("-")[0]
    return SPELLED.get(base, x)


class _Grams:
    """Open-addressed lookup from n-gram keys of one length to row numbers."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        self.bits = max(8, int(np.ceil(np.log2(max(1, len(keys)) * 6))))
        self.slot_row = np.full(1 << self.bits, -1, np.int32)
        self.slot_key = np.zeros(1 << self.bits, np.uint64)
        todo = np.arange(len(keys))
        at = self._at(keys)
        while len(todo):
            free = self.slot_row[at] < 0
            _, first = np.unique(at[free], return_index=True)
            win = np.flatnonzero(free)[first]
            self.slot_row[at[win]] = rows[todo[win]]
            self.slot_key[at[win]] = keys[todo[win]]
            rest = np.ones(len(todo), bool)
            rest[win] = False
            todo, at = todo[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _at(self, keys):
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._at(keys)
        row = self.slot_row[at]
        bad = np.flatnonzero((row >= 0) & (self.slot_key[at] != keys))
        while len(bad):
            at[bad] = (at[bad] + 1) & ((1 << self.bits) - 1)
            row[bad] = self.slot_row[at[bad]]
            bad = bad[(row[bad] >= 0) & (self.slot_key[at[bad]] != keys[bad])]
        return row


_PUNCTUATION = b"0123456789!\"#$%&()*+,./:;<=>?@[]^_`{|}~\r\t-\\"
_BLANK = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))
_MARKS = "«»“”„–—·•©…‘\u00a0\u2007\u202f\u3000"


def prepared(text: str) -> bytes:
    """Lower-case UTF-8 without digits and the marks that all languages share."""
    s = text.lower()
    if not s.isascii():
        for c in _MARKS:
            s = s.replace(c, " ")
    s = s.encode("utf-8", "replace").translate(_BLANK)
    while b"   " in s:
        s = s.replace(b"   ", b" ")
    return s.replace(b"  ", b" ").replace(b"\n ", b"\n").replace(b" \n", b"\n")


class Model:
    """Frozen code lengths. ``samples``: (language, text) pairs."""

    def __init__(self, samples: list[tuple[str, str]], order: int = ORDER):
        self.langs = sorted({lang for lang, _ in samples})
        self.order = order
        n_l = len(self.langs)
        counts = [[defaultdict(Counter) for _ in range(order + 1)] for _ in self.langs]
        for lang, text in samples:
            own = counts[self.langs.index(lang)]
            for line in prepared(text).split(b"\n"):
                s = b"\n" + line + b"\n"
                for i in range(1, len(s)):
                    for k in range(min(order, i) + 1):
                        own[k][s[i - k : i]][s[i]] += 1
        grams = sorted({c + bytes([x]) for own in counts for level in own for c, xs in level.items() for x in xs} | {bytes([x]) for x in range(256)}, key=lambda g: (len(g), g))
        row_of = {g: r for r, g in enumerate(grams)}
        esc = np.zeros((len(grams) + 1, n_l))  # cumulative escape bits along the suffixes of a gram used as context
        sym = np.zeros((len(grams), n_l))
        base = np.zeros(n_l)  # escape of the empty context
        stat = [[{c: (sum(x.values()), len(x)) for c, x in level.items()} for level in own] for own in counts]
        for j in range(n_l):
            t, d = stat[j][0].get(b"", (0, 0))
            base[j] = -np.log2(d / (t + d)) if t else 0.0
        for r, g in enumerate(grams):
            ctx = g[-order:]
            up = ctx[1:] if len(ctx) == len(g) else ctx
            esc[r] = esc[row_of[up]] if up else 0.0
            if len(g) <= order:
                for j in range(n_l):
                    t, d = stat[j][len(g)].get(g, (0, 0))
                    if t:
                        esc[r, j] += -np.log2(d / (t + d))
        for r, g in enumerate(grams):
            c, x = g[:-1], g[-1]
            for j in range(n_l):
                bits = 0.0
                for k in range(len(c), -1, -1):
                    sub = c[len(c) - k :]
                    t, d = stat[j][k].get(sub, (0, 0))
                    if not t:
                        continue
                    seen = counts[j][k][sub].get(x, 0)
                    if seen:
                        bits += -np.log2(seen / (t + d))
                        break
                    bits += -np.log2(d / (t + d))
                else:
                    bits += 8.0
                sym[r, j] = bits
        ctx_row = np.array([row_of[g[:-1]] if len(g) > 1 else len(grams) for g in grams])
        self.esc = esc.astype(np.float32)
        self.sym = (sym - esc[ctx_row]).astype(np.float32)
        self.both = self.sym + self.esc[:-1]
        self.columns = np.ascontiguousarray(self.both.T)
        by = defaultdict(list)
        for r, g in enumerate(grams):
            by[len(g)].append((int.from_bytes(g, "big"), r))
        self.one = np.array([row_of[bytes([x])] for x in range(256)], np.int32)
        self.two = np.full(65536, -1, np.int32)
        for k, r in by[2]:
            self.two[k] = r
        self.more = {m: _Grams(np.array([k for k, _ in by[m]], np.uint64), np.array([r for _, r in by[m]], np.int32)) for m in range(3, order + 2) if by[m]}

    def line_bits(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Of each line of ``raw``: its code length in each language [lines, languages] and its bytes that aren't space."""
        buf = np.frombuffer(b"\n" + raw + b"\n", np.uint8)
        nl = np.flatnonzero(buf == 10)
        row = self.one[buf]
        key = buf.astype(np.uint64)
        gram = key
        inside = buf != 10  # a gram's bytes but its first aren't newlines, so contexts don't reach over lines
        same = np.ones(len(buf), bool)
        for m in range(2, self.order + 2):
            gram = (gram[:-1] << np.uint64(8)) | key[m - 1 :]
            same = same[1:] if m == 2 else same[1:] & inside[1 : len(same)]
            r = self.two[gram.astype(np.int64)] if m == 2 else self.more[m].find(gram) if m in self.more else None
            if r is None:
                break
            hit = (r >= 0) & same
            np.copyto(row[m - 1 :], r, where=hit)
        first = nl[:-1] + 1
        total = np.empty((len(first), len(self.langs)), np.float32)
        for j, column in enumerate(self.columns):
            total[:, j] = np.add.reduceat(column[row], first)
        # of a line's symbols the last (its newline) gives no context, its opening newline does
        total += self.esc[self.one[10]][None, :] - self.esc[row[nl[1:]]]
        return total, np.add.reduceat((buf > 32).astype(np.int32), first)


def smoothed(bits: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Language of each line on the shortest path with ``switch`` bits for each change."""
    n, k = bits.shape
    cost, back = bits[0].copy(), np.zeros((n, k), np.int64)
    for i in range(1, n):
        best = int(cost.argmin())
        jump = cost[best] + switch
        back[i] = np.where(cost <= jump, np.arange(k), best)
        cost = np.minimum(cost, jump) + bits[i]
    path = np.zeros(n, np.int64)
    path[-1] = int(cost.argmin())
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def confidence(bits: np.ndarray) -> np.ndarray:
    """Posterior of the best language under equal priors, per row of code lengths."""
    d = np.clip(bits - bits.min(axis=-1, keepdims=True), 0, 60)
    return 1.0 / np.sum(np.exp2(-d), axis=-1)


def segment(model: Model, texts: list[str]):
    """Per text: (main language index, its total bits, [(line_no, language index, bits)]) or None where blank.

    A line goes to another language than the main one only if its code there is shorter by ``LEAST_BITS`` and by
    ``LEAST_RATE`` for each of its bytes; else it is counted with the main language.
    """
    raws = [prepared(t) for t in texts]
    ends = np.cumsum([r.count(b"\n") + 1 for r in raws])
    bits, size = model.line_bits(b"\n".join(raws))
    best = bits.argmin(axis=1)
    out, k = [], 0
    for e in ends:
        full = k + np.flatnonzero(size[k:e])
        start, k = k, e
        if not len(full):
            out.append(None)
            continue
        b, n, path = bits[full], size[full], best[full]
        if (path != path[0]).any():
            path = smoothed(b)
            main = int(np.bincount(path, weights=n, minlength=b.shape[1]).argmax())
            rows = np.arange(len(full))
            gain = b[:, main] - b[rows, path]
            path = np.where((gain >= LEAST_BITS) & (gain >= LEAST_RATE * n), path, main)
        else:
            main = int(path[0])
        out.append((main, b[path == main].sum(axis=0), list(zip((full - start + 1).tolist(), path.tolist(), b))))
    return out


def train(lang_samples: DataFrame, max_samples: int = MAX_SAMPLES) -> Model:
    """The model from at most ``max_samples`` labelled rows (a small, fixed table)."""
    rows = lang_samples.where("lang is not null and text is not null").orderBy("sample_id").limit(max_samples).select("lang", "text").collect()
    return Model([(r.lang, r.text) for r in rows])


def _labelled(articles: DataFrame, model: Model, findings_only: bool) -> DataFrame:
    if not model.langs:
        return articles.sparkSession.createDataFrame([], "id string, line_no int, lang string, confidence double")
    held = articles.sparkSession.sparkContext.broadcast(model)  # bounded by max_samples
    src = articles.where("id is not null and content is not null").select("id", "language", "content")

    def run(b: pa.RecordBatch):
        m = held.value
        rows, number, lang, conf = [], [], [], []
        labels = b["language"].to_pylist()
        for i, found in enumerate(segment(m, b["content"].to_pylist())):
            if found is None:
                continue
            main, total, lines = found
            if not findings_only or label_code(labels[i]) != m.langs[main]:
                rows.append(i)
                number.append(0)
                lang.append(m.langs[main])
                conf.append(float(confidence(total)))
            for no, p, x in lines:
                if p != main or not findings_only:
                    rows.append(i)
                    number.append(no)
                    lang.append(m.langs[p])
                    conf.append(float(1.0 / np.exp2(-np.clip(x - x[p], -60, 60)).sum()))
        return {"id": b["id"].take(pa.array(rows, pa.int64())), "line_no": number, "lang": lang, "confidence": conf}

    return arrow_map(src, run, "id string, line_no int, lang string, confidence double", rows=50)


_SENTENCE_END = re.compile("(?<=[.!?])[\"'”»’)\\]]*\\s+|(?<=[。！？])[”』」）]*")


def sentence_spans(line: str) -> list[tuple[int, int]]:
    """[start, end) of the sentences of a line that hold anything but blanks."""
    cuts = [0, *(m.end() for m in _SENTENCE_END.finditer(line)), len(line)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if line[a:b].strip()]


def p5_segments(articles: DataFrame, lang_samples: DataFrame) -> DataFrame:
    """(id, line_no, start, length, lang, confidence): runs of sentences of one language in each line; start counts characters from 1.

    Exact copies of a row give one set of rows; two contents of one id give the rows of both.
    """
    model = train(lang_samples)
    schema = "id string, line_no int, start int, length int, lang string, confidence double"
    if not model.langs:
        return articles.sparkSession.createDataFrame([], schema)
    held = articles.sparkSession.sparkContext.broadcast(model)  # bounded by max_samples

    def run(b: pa.RecordBatch):
        m, contents = held.value, b["content"].to_pylist()
        places = [[(no, a, e) for no, line in enumerate(c.split("\n"), 1) for a, e in sentence_spans(line)] for c in contents]
        texts = []
        for c, spans in zip(contents, places):
            lines = c.split("\n")
            texts.append("\n".join(lines[no - 1][a:e].replace("\r", " ") for no, a, e in spans))
        out = {k: [] for k in ("row", "line_no", "start", "length", "lang", "bits")}
        for i, found in enumerate(segment(m, texts)):
            for k, p, x in found[2] if found else ():
                no, a, e = places[i][k - 1]
                if out["row"] and out["row"][-1] == i and out["line_no"][-1] == no and out["lang"][-1] == p:
                    out["length"][-1] = e - out["start"][-1] + 1
                    out["bits"][-1] = out["bits"][-1] + x
                else:
                    for name, v in zip(out, (i, no, a + 1, e - a, p, x)):
                        out[name].append(v)
        sure = [float(1.0 / np.exp2(-np.clip(x - x[p], -60, 60)).sum()) for p, x in zip(out["lang"], out["bits"])]
        return {"id": b["id"].take(pa.array(out["row"], pa.int64())), "line_no": out["line_no"], "start": out["start"], "length": out["length"],
                "lang": [m.langs[p] for p in out["lang"]], "confidence": sure}

    src = articles.where("id is not null and content is not null").select("id", "content")
    return arrow_map(src, run, schema, rows=50).distinct()


def p5_languages(articles: DataFrame, lang_samples: DataFrame) -> DataFrame:
    """(id, line_no, lang, confidence): line 0 is the document, every other row one of its lines."""
    return _labelled(articles, train(lang_samples), False).dropDuplicates(["id", "line_no", "lang"])


def p5_found(articles: DataFrame, lang_samples: DataFrame) -> DataFrame:
    """Line 0 of documents whose label is missing or wrong; lines in another language than the main one."""
    return _labelled(articles, train(lang_samples), True).select("id", "line_no", "lang").dropDuplicates()
