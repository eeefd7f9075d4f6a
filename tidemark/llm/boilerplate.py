"""Main body of web pages by maximum-scoring subsequence (problem 3).

A page is a sequence of words and tags. Words score positive and tags negative; a tag here is what markup leaves behind in
text: separators between short items, copyright signs, the end of a line that ends no sentence, a user name before a
colon. One linear scan finds the contiguous region of words and tags with the greatest sum; lines outside it are dropped, and
inside it those whose own score is clearly negative (prompts set between paragraphs). The page's own headline is kept
where it stands above the body.

Word weights are fitted on labelled pages. The labels come from the tables: a line of a page whose form stands on pages of
at least ``STORIES`` different stories is furniture; a line of content that wasn't taken from a page and that no other story has, and
every clean sample, is body. A weight is the log odds of the word in the two kinds of lines. The fit takes about ``MAX_PAGES``
pages and as many other rows (a documented bound, chosen by hash); all pages are scored.

Defined results: rows of methods that aren't pages, null and blank contents have no rows; blank lines are never rows; a
page without any positive line is dropped whole. Copies of a row count once. With too few pages to learn from, tags alone decide.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrow import arrow_map
from tidemark.llm.lookalike import canonical

#: A line form on pages of so many stories is furniture.
STORIES = 3
#: Rows of each kind that the weights are fitted on.
MAX_PAGES, MAX_SAMPLES = 4000, 4000
#: How much body text weighs against furniture, and the count added to both.
BALANCE, SMOOTH = 2.0, 0.2
WORD_LOW, WORD_HIGH, WORD_NEW = -4.0, 1.0, 0.35
LINE_LOW, LINE_HIGH = -5.0, 40.0
#: A long sentence is furniture only if its words weigh less than this on average.
SENTENCE_LOW = -0.6
#: Lines of the region with at most this score are dropped.
DROP = -3.0

_TOKEN = re.compile(r"[^\W\d_]+")
_NUMBER = re.compile("[0-9]+")
_HAN = re.compile("[一-鿿]+")
_TERMINAL = re.compile(r"[.!?…。！？]['\"”»“’）)\]]*$|['\"”»“’]$")
_SEPARATOR = re.compile(r"(?<=\S)(?:\s*[|·»›/•]\s+|\s+[>|·»›/]\s*|\s{2,})(?=\S)")
_USER = re.compile(r"^[^\W\d_A-ZА-Я]+\d{1,4}:\s")
_ITEM = re.compile(r"^\s*(?:[-•*–]|\d{1,2}[.)])\s+")
_BRACKET = re.compile(r"^[(（].*[)）]$")
_STAMP = re.compile(r"\d{1,4}[./-]\d{1,2}[./-]\d{2,4}")


def tokens(line: str) -> list[str]:
    """Lower-case words; runs of Han characters as pairs."""
    low = line.lower()
    if low.isascii() or not (runs := _HAN.findall(low)):
        return _TOKEN.findall(low)
    return _TOKEN.findall(_HAN.sub(" ", low)) + [t[i : i + 2] for t in runs for i in range(max(1, len(t) - 1))]


class Weights(dict):
    """Weight of a word; words of neither kind of text weigh ``WORD_NEW``. ``labels``: furniture forms that may stand before a colon."""

    labels: frozenset[str] = frozenset()

    def __missing__(self, word: str) -> float:
        return WORD_NEW


def line_form(line: str) -> str:
    return re.sub(r"\s+", " ", _NUMBER.sub("", line)).strip().lower()


def labelled(pages_: list[tuple[str, str]], others: list[str], samples: list[str]) -> tuple[dict[str, int], list[str]]:
    """(furniture forms and the number of stories that show each, body lines) of (story, content) of pages, other contents and clean samples."""
    shown: dict[str, set[str]] = {}
    for story, content in pages_:
        for f in {line_form(x) for x in canonical(content).split("\n")}:
            shown.setdefault(f, set()).add(story)
    furniture = {f: len(s) for f, s in shown.items() if f and len(s) >= STORIES}
    lines = [[(line_form(x), x) for x in canonical(c).split("\n")] for c in others]
    n = Counter(f for xs in lines for f in {f for f, _ in xs})
    return furniture, [x for xs in lines for f, x in xs if f and n[f] == 1 and f not in furniture] + samples


def weights(furniture: dict[str, int], body: list[str]) -> Weights:
    """Log odds of every word of the labelled lines; words of neither weigh ``WORD_NEW``."""
    bad, good = Counter(), Counter()
    for f, n in furniture.items():
        for w in tokens(f):
            bad[w] += 1 + math.log(n)
    for x in body:
        good.update(tokens(x))
    share = BALANCE * bad.total() / max(good.total(), 1)
    out = Weights({w: min(WORD_HIGH, max(WORD_LOW, WORD_NEW + math.log((good[w] * share + SMOOTH) / (bad[w] + SMOOTH)))) for w in bad.keys() | good.keys()})
    out.labels = frozenset(f for f in furniture if len(f) < 40)
    return out


def ended(line: str) -> bool:
    return bool(_TERMINAL.search(line, max(0, len(line) - 12)))


def line_score(line: str, weight: Weights, ws: list[float] | None = None) -> float:
    """Words positive, tags negative; ``line`` is stripped and canonical. ``ws``: the weights of its words."""
    if _USER.match(line):
        return LINE_LOW
    if line.count(" > ") > 1 or line.count(" » ") > 1 or line.count(" › ") > 1:
        return LINE_LOW  # the way to the page
    words = [weight[w] for w in tokens(line)] if ws is None else ws
    s = min(LINE_HIGH, sum(words))
    end = ended(line)
    if len(words) > 25 and "©" not in line and (end or s > 0):
        return max(LINE_LOW, s) if s / len(words) <= SENTENCE_LOW else max(s, 1.0)
    if end and len(words) > 12 and "©" not in line and s / len(words) > SENTENCE_LOW:
        return max(s, 1.0)
    if _BRACKET.match(line):
        return max(2.0, min(s, 4.0))
    if "©" in line:
        s -= 8
    n = len(_SEPARATOR.findall(line))
    if n and (n > 1 or not end) and len(words) <= 4 * (n + 1) + 4:
        s = min(s, 2.0) - 3.0 * n
    if len(words) <= 10 and _STAMP.search(line):
        s -= 4
    if end:
        return max(LINE_LOW, s)
    if _ITEM.match(line) and line[-1] in ")）":
        return max(2.0, min(s, 6.0))
    label, colon, _ = line.partition(": ")
    if colon and len(label) < 40 and (sum(map(weight.__getitem__, tokens(label))) < -1.5 or line_form(label) in weight.labels):
        return LINE_LOW
    return max(LINE_LOW, min(s, 2.0) - 2.5)


def best_region(scores) -> tuple[int, int]:
    """First contiguous region with the greatest sum, as [start, end); empty where nothing is positive."""
    total = np.concatenate([[0.0], np.cumsum(np.asarray(scores, float))])
    low = np.minimum.accumulate(total)
    gain = total - low
    end = int(gain.argmax())
    if gain[end] <= 1e-9:
        return 0, 0
    return int(np.flatnonzero(total[:end] == low[end])[-1]), end


def elements(ws: list[float], score: float) -> list[float]:
    """Weights of the words of a line and of its closing tag, which is never positive; together they make the line's score.

    What a score is held up by (a long sentence, the bound on furniture) is shared by the words, as is the bound on long lines.
    """
    whole = sum(ws)
    if whole > LINE_HIGH:
        ws, whole = [w * LINE_HIGH / whole for w in ws], LINE_HIGH
    more = score - whole
    if more > 0 and ws:
        ws, more = [w + more / len(ws) for w in ws], 0.0
    return [*ws, more]


def body_lines(words: list[list[float]], scores: list[float]) -> tuple[int, int]:
    """[first, end) of the lines that the best region of words and tags touches."""
    per = [elements(ws, s) for ws, s in zip(words, scores)]
    flat = [v for vs in per for v in vs]
    a, b = best_region(flat)
    if a == b:
        return 0, 0
    ends = np.cumsum([len(vs) for vs in per])
    return int(np.searchsorted(ends, a, "right")), int(np.searchsorted(ends, b - 1, "right")) + 1


def _same(a: str, b: str) -> bool:
    a, b = re.sub(r"\W+", " ", a.casefold()).strip(), re.sub(r"\W+", " ", b.casefold()).strip()
    return bool(a) and bool(b) and (a == b or (min(len(a), len(b)) > 12 and (a.startswith(b) or b.startswith(a))))


def furniture_lines(content: str, title: str | None, weight: Weights) -> list[int]:
    """Numbers (from 1) of the lines to drop."""
    lines = [(i, x.strip()) for i, x in enumerate(canonical(content).split("\n"), 1)]
    lines = [(i, x) for i, x in lines if x]
    if not lines:
        return []
    words = [[weight[w] for w in tokens(x)] for _, x in lines]
    scores = [line_score(x, weight, ws) for (_, x), ws in zip(lines, words)]
    a, b = body_lines(words, scores)
    keep = {k for k in range(a, b) if scores[k] > DROP}
    # headlines of other articles: two or more unended lines in a row, or after a dropped unended line, numbered or not
    k = a
    while k < b:
        e = k
        while e < b and not ended(lines[e][1]) and not (_BRACKET.match(lines[e][1]) or scores[e] >= 2.0):
            e += 1
        run = [j for j in range(k, e) if j in keep]
        if len(run) > 1 or (run and e - k > len(run) and len(tokens(lines[run[0]][1])) > 5):
            for j in run:
                if not (title and _same(lines[j][1], title)) and len(tokens(lines[j][1])) > 4:
                    keep.discard(j)
        k = max(e, k + 1)
    last = len(lines) - 1
    if 0 < last <= b and last not in keep and last - 1 in keep and ended(lines[last - 1][1]) and not _ITEM.match(lines[last][1]):
        if scores[last] > DROP and sum(map(weight.__getitem__, tokens(lines[last][1]))) > 0:
            keep.add(last)  # a paragraph that breaks off
    head = None
    if title and title.strip():
        wanted = canonical(title).strip()
        head = next((k for k in range(b) if _same(lines[k][1], wanted) and not _SEPARATOR.search(lines[k][1])), None)
    elif a < b:
        for k in range(a - 1, max(-1, a - 6), -1):
            if scores[k] > DROP and len(tokens(lines[k][1])) > 4 and not _SEPARATOR.search(lines[k][1]) and not _ITEM.match(lines[k][1]):
                head = k
                break
    if head is not None:
        keep.add(head)
    return [n for k, (n, _) in enumerate(lines) if k not in keep]


def train(articles: DataFrame, collector_clocks: DataFrame, lang_samples: DataFrame, max_pages: int = MAX_PAGES, max_samples: int = MAX_SAMPLES) -> Weights:
    """Word weights from about ``max_pages`` pages and as many other contents, and at most ``max_samples`` clean texts."""
    methods = collector_clocks.where("is_page").select("collection_method", F.lit(True).alias("__page")).distinct()
    rows = articles.where("id is not null").join(methods, "collection_method", "left").withColumn("__page", F.coalesce("__page", F.lit(False)))
    n = {r["__page"]: r["count"] for r in rows.groupBy("__page").count().collect()}
    # the same rows whenever asked: those whose hash lies under a threshold, as fine as the table is large
    take = lambda k: F.lit(min(2**63 - 1, int(max_pages / max(1, n.get(k, 0)) * 2**64) - 2**63))
    some = rows.where(F.xxhash64("id", F.lit(3)) <= F.when(F.col("__page"), take(True)).otherwise(take(False))).where("content is not null")
    got = {r.id: r for r in some.select("id", "title", "content", "__page").limit(4 * max_pages).collect()}
    got = [got[k] for k in sorted(got)]
    samples = [r.text for r in lang_samples.where("text is not null").orderBy("sample_id").limit(max_samples).select("text").collect()]
    return weights(*labelled([(r.title or r.id, r.content) for r in got if r["__page"]], [r.content for r in got if not r["__page"]], samples))


def pages(articles: DataFrame, collector_clocks: DataFrame) -> DataFrame:
    methods = collector_clocks.where("is_page").select("collection_method").dropDuplicates()
    return articles.where("id is not null and content is not null").select("id", "title", "content", "collection_method").join(methods, "collection_method", "left_semi")


def p3_found(articles: DataFrame, collector_clocks: DataFrame, lang_samples: DataFrame) -> DataFrame:
    """(id, line_no): lines of web pages that don't belong to the main body."""
    held = articles.sparkSession.sparkContext.broadcast(train(articles, collector_clocks, lang_samples))  # bounded by max_pages and max_samples

    def run(b: pa.RecordBatch):
        rows, number = [], []
        for i, (t, c) in enumerate(zip(b["title"].to_pylist(), b["content"].to_pylist())):
            found = furniture_lines(c, t, held.value)
            rows += [i] * len(found)
            number += found
        return {"id": b["id"].take(pa.array(rows, pa.int64())), "line_no": number}

    return arrow_map(pages(articles, collector_clocks), run, "id string, line_no int").dropDuplicates()


def main_body(articles: DataFrame, collector_clocks: DataFrame, lang_samples: DataFrame) -> DataFrame:
    """(id, body): the main body of every web page; null where nothing of it is left."""
    held = articles.sparkSession.sparkContext.broadcast(train(articles, collector_clocks, lang_samples))

    def run(b: pa.RecordBatch):
        out = []
        for t, c in zip(b["title"].to_pylist(), b["content"].to_pylist()):
            gone = set(furniture_lines(c, t, held.value))
            kept = [x for i, x in enumerate(c.split("\n"), 1) if i not in gone and x.strip()]
            out.append("\n".join(kept) or None)
        return {"id": b["id"], "body": out}

    return arrow_map(pages(articles, collector_clocks), run, "id string, body string")
