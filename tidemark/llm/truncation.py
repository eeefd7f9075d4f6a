"""Text cut off by field limits or in transfer (problem 1).

The method is a self-join on prefixes. A value that was cut is a strict prefix of a longer copy elsewhere: of the whole
text, or, where no other text begins alike, of the sentence it breaks off in. Both are one join, since the last
sentence of a cut text is the strict prefix of that sentence in any longer copy. Each sentence is brought to its form
(no digits, proper names or case), and prefixes of fixed lengths ``FIRST * 2**k`` bytes are hashed. A sentence gives one row
(hash of its first g bytes, the next g) for each such length g; what a content ends with is looked up by the
greatest g that fits: sorted by the rest, a strict prefix stands right before a row that goes on from it. Every text is
thereby moved about once, in small rows that combine before the shuffle, and no row holds a whole text.

A content whose last sentence ended is complete, even if other copies go on with more sentences (a summary).
An unended last line that is known as complete (it stands inside contents or as a title) isn't cut either.

Where no longer copy exists the break itself decides: a mark left by the cutter (an ellipsis, a count of missing
characters, half a character, half a tag), or an unended last line whose form is nowhere complete. Where contents of one
source and method break off again and again at the same length, that length is taken as a field limit, and values
that fill it exactly are cut even if they happen to end with a sentence. ``p1_evidence`` reports what decided.

Defined results: null and blank contents have no rows; a null id has none; copies of a row count once; a null source is
reported as null; an id that stands under two sources counts for both.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.arrow import arrow_map
from tidemark.llm.lookalike import canonical
from tidemark.llm.rolling import Rolling, gather
from tidemark.session import cut_lineage

#: A field limit needs so many values of exactly its length, and so great a share of them visibly broken off.
LIMIT_ROWS, LIMIT_SHARE = 4, 0.6
#: ... and so many times the average of the lengths at most AROUND away.
SPIKE, AROUND = 8, 10
#: A line is complete if its form stands inside contents of two ids, and so often for each content that ends with it.
WHOLE_SHARE = 0.05
#: Least length of a hashed prefix; shorter values are prefixes of too much to prove anything.
FIRST = 12
#: Rows a task remembers to have sent already.
SEEN = 1_000_000

_MARK = re.compile(r"(?:\[\s?\+?\s?\d+\s?(?:chars?|characters|more)?\s?\]|\[\s?(?:…|\.{3})\s?\]|\(\s?(?:…|\.{3})\s?\)|…|\.{3})\s*$")
_BROKEN = re.compile("(?:�+|<[A-Za-z/!][^<>]*|&(?:#\\d*|#x[0-9a-fA-F]*|[A-Za-z]{1,8})?)\\s*$")
_END = re.compile("[.!?。！？…)\\]）】»”\"'’“]\\s*$")
_LEAD = re.compile(r"^\s*(?:[-•*–]|\d{1,2}[.)])\s+")
_NAME_AT = r"[^\W\d_a-zа-яß-öø-ÿ一-鿿][\w'’-]*"
_NAME = re.compile(r"(?<=[\s(«“„\"'’-])" + _NAME_AT)
_NAME_AFTER = re.compile(r"([ \t(«“„\"'’-])" + _NAME_AT)
_INNER = re.compile(r"[.!?]['\"”»’]?\s+\S|[。！？][”』」]?.")
_SENTENCE = re.compile("[.!?][\"'”»’)\\]]*\\s+|[。！？][”』」）]*|\r?\n")
_CRUMBS = re.compile(r"\s[>»›/|·]\s\S.*\s[>»›/|·]\s\S")
_NUMBERS = re.compile("[0-9]+")
_BLANKS = re.compile(r"[ \t\r]*\n[ \t\r\n]*|[ \t\r]{2,}")


def line_form(line: str) -> str:
    """The line without bullets, digits, proper names and a trailing place after a colon, in lower case."""
    s = _LEAD.sub("", canonical(line)).strip()
    s = re.sub(r"[:：]\s*\S+(?:\s\S+)?$", "", s)
    s = _NAME.sub("#", s)
    return re.sub(r"\s+", " ", re.sub(r"\d+", "", s)).strip().lower()


def tail_form(form: str) -> str:
    """How a line ends: its last three words, or its last six characters in a script without blanks."""
    words = form.split(" ")
    return "…" + (" ".join(words[-3:]) if len(words) > 1 else form[-6:])


def look(content: str) -> tuple[str, str, str]:
    """(sign, form, tail): sign is ``mark``, ``broken``, ``open`` (prose that breaks off), ``short`` or empty (ended).

    ``tail`` is set for items of a list and for a line after another unended one, which are known by how they end.
    """
    text = content.rstrip()
    line = text[text.rfind("\n") + 1 :]
    if _MARK.search(text[-40:]):
        return "mark", "", ""
    if _BROKEN.search(line):
        return "broken", "", ""
    plain = canonical(line).rstrip()
    if not plain:
        return "", "", ""
    if _END.search(plain[-3:]) and (plain[-1] not in "\"'’“”" or re.search("[.!?。！？…,，][\"'’“”]{1,2}$", plain)):
        return "", "", ""
    form = line_form(line)
    before = text[: len(text) - len(line)].rstrip()
    listed = _LEAD.match(plain) or (before and not _END.search(before[-3:]))
    if _INNER.search(plain) and not _LEAD.match(plain):
        return "open", form, ""
    return "short", form, tail_form(form) if listed else ""


def complete_forms(content: str, title: str | None) -> set[str]:
    """Forms of the unended lines that are surely whole: all but the last line, and the title.

    The way to the page (a row of links) is often cut by the page itself, so how it ends says nothing.
    """
    lines = content.rstrip().split("\n")[:-1]
    if title:
        lines.append(title)
    out = set()
    for x in lines:
        if x.strip() and not _END.search(x.rstrip()[-3:]) and (f := line_form(x)):
            out.add(f)
            if not _CRUMBS.search(x):
                out.add(tail_form(f))
    return out


def sentences(content: str) -> str:
    """Forms of the sentences and lines of a content in order, each on a line; without the marks they end with."""
    s = _SENTENCE.sub("\n", canonical(content))
    s = _NUMBERS.sub("", _NAME_AFTER.sub(r"\1#", s))
    return _BLANKS.sub(lambda m: "\n" if "\n" in m.group() else " ", s).strip().lower()


def last_sentence(content: str, sign: str) -> str:
    """Form of what the content breaks off in, without the cutter's mark."""
    text = content.rstrip()
    if sign in ("mark", "broken"):
        text = (_MARK if sign == "mark" else _BROKEN).sub("", text[-4000:] if "\n" in text[-4000:-40] else text)
    line = text.rstrip()
    return sentences(line[line.rfind("\n") + 1 :]).rpartition("\n")[2]


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


def _lines(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of the lines of all texts that are long enough."""
    buf = np.frombuffer(("\n".join(texts) + "\n").encode("utf-8", "surrogatepass"), np.uint8)
    ends = np.flatnonzero(buf == 10)
    starts = np.append(0, ends[:-1] + 1)
    keep = ends - starts >= FIRST
    return buf, starts[keep], ends[keep]


def prefixes(texts: list[str], looked_up: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every line of at least FIRST bytes: (line, hash of a prefix, hash of what follows, what follows as bytes and offsets).

    One row for each fixed length that fits, with the next as many bytes; ``looked_up``: the greatest one only, with all the rest.
    """
    buf, starts, ends = _lines(texts)
    roll = Rolling(buf)
    line, at, stop = [], [], []
    g, size = FIRST, ends - starts
    while len(k := np.flatnonzero(size >= g)):
        if looked_up:
            k = k[size[k] < 2 * g]
        line.append(k)
        at.append(starts[k] + g)
        stop.append(np.minimum(starts[k] + 2 * g, ends[k]))
        g *= 2
    if not line:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint8), np.zeros(1, np.int64)
    line, at, stop = (np.concatenate(x) for x in (line, at, stop))
    return line, roll.of(starts[line], at), roll.of(at, stop), *gather(buf, at, stop)


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def _contents(articles: DataFrame) -> DataFrame:
    return articles.where("id is not null and content is not null").select("id", "title", "content", "source_uri", "collection_method")


def _observed(articles: DataFrame) -> DataFrame:
    """One row per content with its signs (kind ``c``), and per batch one per complete form (kind ``f``, with n of its contents and two of its ids)."""
    names = ("kind", "id", "source_uri", "method", "sign", "form", "tail", "value", "chars", "bytes", "n", "id_low", "id_high")

    def run(b: pa.RecordBatch):
        cols = {k: [] for k in names}
        forms: dict[str, list] = {}
        for i, t, c, s, m in zip(*(b[k].to_pylist() for k in ("id", "title", "content", "source_uri", "collection_method"))):
            if not c.strip():
                continue
            sign, form, tail = look(c)
            value = _hash(last) if sign and (last := last_sentence(c, sign)) else None
            for v, k in zip(("c", i, s, m, sign, _hash(form) if form else None, _hash(tail) if tail else None, value, len(c), len(c.encode("utf-8", "replace")), 1, None, None), names):
                cols[k].append(v)
            for f in complete_forms(c, t):
                x = forms.setdefault(f, [0, i, i])
                x[0] += 1
                x[1], x[2] = min(x[1], i), max(x[2], i)
        for f, (n, lo, hi) in forms.items():
            for v, k in zip(("f", None, None, None, "", _hash(f), None, None, 0, 0, n, lo, hi), names):
                cols[k].append(v)
        return cols

    schema = "kind string, id string, source_uri string, method string, sign string, form long, tail long, value long, chars int, bytes int, n long, id_low string, id_high string"
    return arrow_map(_contents(articles), run, schema, rows=2000)


def longer_values(articles: DataFrame) -> DataFrame:
    """(value): hashes of the forms that contents break off with and that are strict prefixes of a sentence elsewhere.

    Rows of equal prefix and rest combine in the batch and before the shuffle, so a prefix that a third of the corpus
    shares brings only its distinct continuations (at most one length further) to one task, where they are streamed in order.
    """

    seen: set[int] = set()

    def run(b: pa.RecordBatch):
        texts = [sentences(c) for c in b["content"].to_pylist()]
        _, prefix, rest, data, offsets = prefixes(texts)
        pair = prefix * 31 + rest
        _, first = np.unique(pair, return_index=True)
        if len(seen) > SEEN:
            seen.clear()
        known = pair.tolist()
        first = np.array([k for k in first.tolist() if known[k] not in seen], np.int64)
        seen.update(known[k] for k in first.tolist())
        data, more = gather(data, offsets[first], offsets[first + 1])
        last = [x for c in b["content"].to_pylist() if c.strip() and (sign := look(c)[0]) and (x := last_sentence(c, sign))]
        last = [x for x in dict.fromkeys(last) if len(x.encode("utf-8", "surrogatepass")) >= FIRST]
        line, asked, _, asked_data, asked_offsets = prefixes(last, True)
        return {
            "prefix": np.concatenate([prefix[first], asked]), "rest": pa.concat_arrays([_binary(data, more), _binary(asked_data, asked_offsets)]),
            "value": pa.array([None] * len(first) + [_hash(last[k]) for k in line.tolist()], pa.int64()),
        }

    rows = arrow_map(_contents(articles), run, "prefix long, rest binary, value long", rows=1000)
    each = rows.groupBy("prefix", "rest").agg(F.max("value").alias("value"))
    after = F.lead("rest").over(Window.partitionBy("prefix").orderBy("rest"))
    return each.withColumn("next", after).where("value is not null and startswith(next, rest)").select("value").distinct()


def longer_copies(articles: DataFrame) -> DataFrame:
    """(id): contents that break off in a sentence of which a longer copy stands elsewhere."""

    def run(b: pa.RecordBatch):
        ids, values = [], []
        for i, c in zip(b["id"].to_pylist(), b["content"].to_pylist()):
            if c.strip() and (sign := look(c)[0]) and (last := last_sentence(c, sign)):
                ids.append(i)
                values.append(_hash(last))
        return {"id": ids, "value": values}

    return arrow_map(_contents(articles), run, "id string, value long").join(longer_values(articles), "value").select("id").dropDuplicates()


def _limits(rows: DataFrame) -> DataFrame:
    """(id): undecided contents that fill a length at which contents break off far more often than at the lengths around.

    Lengths are counted in characters and bytes, per source and method and per method.
    """
    # fixed values: scope and unit
    of = [F.struct(F.lit(f"{scope}/{unit}").alias("what"), (F.col("source_uri") if scope == "source" else F.lit("*")).alias("s"), F.col("method").alias("m"), F.col(unit).alias("size")) for scope in ("source", "method") for unit in ("chars", "bytes")]
    long = rows.select("id", "off", F.explode(F.array(*of)).alias("k")).select("id", "off", "k.*").where("s is not null and m is not null")
    g = long.groupBy("what", "s", "m", "size").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("off").cast("int")).alias("cut"))
    near = Window.partitionBy("what", "s", "m").orderBy("size").rangeBetween(-AROUND, AROUND)
    g = g.withColumn("around", F.sum("cut").over(near) - F.col("cut"))
    spike = (F.col("cut") >= LIMIT_ROWS) & (F.col("cut") >= F.lit(LIMIT_SHARE) * F.col("k")) & (F.col("cut") * (2 * AROUND) >= F.lit(SPIKE) * F.col("around"))
    at = ["what", "s", "m", "size"]
    return long.where(~F.col("off")).join(g.where(spike).select(*at), at, "left_semi").select("id").distinct()


def cut_articles(articles: DataFrame) -> DataFrame:
    """(id, source_uri, evidence) of every cut content; evidence is the first that holds of ``longer copy``, the sign, ``limit``."""
    seen = cut_lineage(_observed(articles))
    f = seen.where("kind = 'f'").select("form", "n", F.lit(0).cast("long").alias("ends"), "id_low", "id_high")
    ends = seen.where("kind = 'c' and sign in ('open', 'short')").select(F.explode(F.array("form", "tail")).alias("form")).where("form is not null")
    ends = ends.select("form", F.lit(0).cast("long").alias("n"), F.lit(1).cast("long").alias("ends"), *[F.lit(None).cast("string").alias(c) for c in ("id_low", "id_high")])
    whole = f.unionByName(ends).groupBy("form").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"), F.min("id_low").alias("lo"), F.max("id_high").alias("hi"))
    whole = whole.where((F.col("ends") > 0) & (F.col("lo") != F.col("hi")) & (F.col("n") >= F.lit(WHOLE_SHARE) * F.col("ends"))).select("form")
    # only contents that break off take part in the joins, so no null or empty key gathers the others
    rows = seen.where("kind = 'c'").select("id", "source_uri", "method", "sign", "form", "tail", "value", "chars", "bytes")
    broken = rows.where("sign <> ''")
    unsure = broken.where("sign in ('open', 'short')")
    known = unsure.join(whole, "form", "left_semi").select("id").union(unsure.join(whole.withColumnRenamed("form", "tail"), "tail", "left_semi").select("id")).distinct()
    off = broken.join(known, "id", "left_anti").join(longer_values(articles).withColumn("longer", F.lit(True)), "value", "left")
    cut = off.select("id", "source_uri", F.when(F.col("longer"), "longer copy").when(F.col("sign").isin("mark", "broken"), F.col("sign")).otherwise("unended").alias("evidence"))
    cut = cut_lineage(cut.dropDuplicates(["id", "source_uri"]))
    plain = rows.where("sign in ('', 'open', 'short')").join(cut.select("id", F.lit(True).alias("off")), "id", "left").withColumn("off", F.coalesce("off", F.lit(False)))
    full = rows.select("id", "source_uri").join(_limits(plain), "id", "left_semi").select("id", "source_uri", F.lit("limit").alias("evidence")).dropDuplicates(["id", "source_uri"])
    return cut.unionByName(full)


def p1_found(articles: DataFrame) -> DataFrame:
    return cut_articles(articles).select("id").distinct()


def p1_evidence(articles: DataFrame) -> DataFrame:
    """(evidence, n): how many of the rows of ``p1_found`` each kind of evidence decides."""
    return cut_articles(articles).groupBy("id").agg(F.min("evidence").alias("evidence")).groupBy("evidence").agg(F.count(F.lit(1)).alias("n"))


def p1_sources(articles: DataFrame) -> DataFrame:
    """(source_uri, n_ids, n_cut, share): how often each source cuts, over its ids with a content."""
    all_ = articles.where("id is not null and length(trim(content)) > 0").select("id", "source_uri").distinct()
    cut = p1_found(articles).withColumn("cut", F.lit(1))
    g = all_.join(cut, "id", "left").groupBy("source_uri").agg(F.count(F.lit(1)).alias("n_ids"), F.sum(F.coalesce("cut", F.lit(0))).alias("n_cut"))
    return g.withColumn("share", F.round(F.col("n_cut") / F.col("n_ids"), 4))
