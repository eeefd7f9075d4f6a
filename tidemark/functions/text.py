"""Phrase matching, document lengths and BM25, JVM-side."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

#: A word character: letters, numbers and the underscore (marks don't count).
W = r"[\p{L}\p{N}_]"
CJK = ["zho", "jpn", "tha", "kor"]
# Names of languages and their ISO 639-3 codes.
LANGUAGE_CODES = {
    "Albanian": "sqi", "Arabic": "ara", "Bengali": "ben", "Bulgarian": "bul", "Chinese": "zho", "Croatian": "hrv", "Czech": "ces", "Danish": "dan",
    "Dhivehi": "div", "Dutch": "nld", "English": "eng", "Finnish": "fin", "French": "fra", "Ganda": "lug", "German": "deu", "Greek": "ell", "Hebrew": "heb",
    "Hungarian": "hun", "Indonesian": "ind", "Irish": "gle", "Italian": "ita", "Japanese": "jpn", "Korean": "kor", "Malay": "msa", "Malayalam": "mal",
    "Norwegian": "nob", "Persian": "fas", "Polish": "pol", "Portuguese": "por", "Romanian": "ron", "Russian": "rus", "Serbian": "srp", "Slovak": "slk",
    "Spanish": "spa", "Swahili": "swa", "Swedish": "swe", "Thai": "tha", "Turkish": "tur", "Ukrainian": "ukr", "Urdu": "urd", "Vietnamese": "vie",
}
K1, B = 1.5, 0.75


def java_escape(term: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|#&~\-])", r"\\\1", term)


def whole_phrase(term: str) -> str:
    """Pattern of ``term`` between word boundaries, literal first: Java looks for the literal, then checks its sides."""
    e = java_escape(term)
    tail = f"(?!{W})" if re.match(r"[^\W]", term[-1]) else f"(?={W})"
    head = f"(?<!{W}{e})" if re.match(r"[^\W]", term[0]) else f"(?<={W}{e})"
    return e + tail + head


def any_phrase(terms: list[str]) -> str:
    """One pattern for "any of the terms as a whole phrase", ignoring case."""
    edge = f"(?:(?<={W})(?!{W})|(?<!{W})(?={W}))"
    return "(?iu)" + edge + "(?:" + "|".join(java_escape(t) for t in terms) + ")" + edge


def full_text(title: Column, content: Column, sep: str = " ") -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(sep), F.coalesce(content, F.lit("")))


def language_code(name: Column, default: str = "") -> Column:
    """ISO 639-3 code of a language's English name; the default for other names and null."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGE_CODES.items() for x in kv]), name), F.lit(default))


def keyword_match(text: Column, lang: Column, terms: dict[str, list[str]], fallback: str = "eng") -> Column:
    """Whether any term of the row's language occurs; languages without spaces match substrings, unknown ones the fallback's terms.

    ``terms`` holds the united lists of ``keywords.with_english``. One literal pattern per language, compiled once per task.
    """
    out = F.lit(False)
    for code, ts in [(c, t) for c, t in terms.items() if t]:
        if code in CJK:
            low = F.lower(text)
            hit = F.lit(False)
            for t in ts:
                hit = hit | low.contains(t.lower())
        else:
            hit = text.rlike(any_phrase(ts))
        out = F.when(lang == code, hit).otherwise(out)
    if terms.get(fallback):
        known = F.coalesce(lang.isin(list(terms)), F.lit(False))
        out = F.when(known, out).otherwise(text.rlike(any_phrase(terms[fallback])))
    return F.coalesce(out, F.lit(False))


def phrase_count(text_lower: Column, term: str) -> Column:
    """Whole-phrase hits that don't overlap, in lower-cased text."""
    t = term.lower()
    return F.when(text_lower.contains(t), F.regexp_count(text_lower, F.lit(whole_phrase(t)))).otherwise(0)


def substring_count(text: Column, term: str) -> Column:
    """Hits that don't overlap, with case."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / F.lit(len(term))).cast("int")


def doc_length(text: Column, lang: Column) -> Column:
    """Code points in languages without spaces, else tokens between white space."""
    toks = F.size(F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda x: x != ""))
    return F.when(lang.isin(CJK), F.length(text)).otherwise(toks)


def term_hits(text: Column, lang: str, terms: list[str]) -> Column:
    """array<struct<term, tf>> of the terms that occur."""
    low = F.lower(text)
    found = [F.struct(F.lit(t).alias("term"), (substring_count(text, t) if lang in CJK else phrase_count(low, t)).cast("int").alias("tf")) for t in terms]
    return F.filter(F.array(*found), lambda h: h["tf"] > 0)


def hits(docs: DataFrame, terms: dict[str, dict[str, list[str]]], key: str, text: str, lang: str) -> DataFrame:
    """(key, lang, dl, <topic> hits): every document of a known language is matched once; its text is dropped."""
    langs = sorted({code for t in terms.values() for code in t})
    cols = {}
    for topic, by in terms.items():
        c = F.array().cast("array<struct<term:string,tf:int>>")
        for code in langs:
            if by.get(code):
                c = F.when(F.col(lang) == code, term_hits(F.col(text), code, by[code])).otherwise(c)
        cols[topic] = c
    return docs.where(F.col(lang).isin(langs)).select(key, lang, doc_length(F.col(text), F.col(lang)).cast("long").alias("dl"), *[c.alias(k) for k, c in cols.items()])


def topic_terms(topic: str) -> Column:
    """array<struct<topic, term>> of the hits of one topic."""
    return F.transform(topic, lambda h: F.struct(F.lit(topic).alias("topic"), h["term"].alias("term")))


def bm25(matched: DataFrame, key: str, lang: str, topics: list[str], k1: float = K1, b: float = B) -> DataFrame:
    """(key, lang, bm25_<topic>..., bm25_avg): Okapi scores with statistics per language over all documents.

    The documents are matched once and kept as narrow rows without text. One aggregate counts documents, lengths and
    terms; it comes back as one row per language (as large as the dictionary, whatever the corpus) and each row is scored in place.
    """
    matched = cut_lineage(matched)
    of = lambda t: F.transform(t, lambda h: F.struct(F.lit(t).alias("topic"), h["term"].alias("term"), F.lit(0).cast("long").alias("dl")))
    every = F.concat(F.array(F.struct(F.lit("").alias("topic"), F.lit("").alias("term"), F.col("dl").cast("long").alias("dl"))), *map(of, topics))
    counts = matched.select(lang, F.explode(every).alias("e")).groupBy(lang, "e.topic", "e.term").agg(F.count(F.lit(1)).alias("n"), F.sum("e.dl").alias("dl"))
    whole = F.max(F.when(F.col("topic") == "", F.struct("n", "dl")))
    model = counts.groupBy(lang).agg(whole.alias("__all"), F.collect_list(F.when(F.col("topic") != "", F.struct(F.concat("topic", F.lit("/"), "term").alias("k"), "n"))).alias("__df"))
    model = model.select(F.col(lang).alias("__lang"), F.col("__all.n").alias("__n"), (F.col("__all.dl") / F.col("__all.n")).alias("__avg"), F.map_from_entries("__df").alias("__df"))
    x = matched.join(model, F.col(lang) == F.col("__lang"), "left")  # the planner broadcasts it by its measured size

    def score(topic: str) -> Column:
        def add(s: Column, h: Column) -> Column:
            df = F.element_at(F.col("__df"), F.concat(F.lit(f"{topic}/"), h["term"]))
            idf = F.log((F.col("__n") - df + 0.5) / (df + 0.5) + 1.0)
            return s + idf * h["tf"] * (k1 + 1) / (h["tf"] + k1 * (1 - b + b * F.col("dl") / F.col("__avg")))

        return F.aggregate(topic, F.lit(0.0), add)

    out = x.select(key, lang, *[score(t).alias(f"bm25_{t}") for t in topics])
    return out.withColumn("bm25_avg", sum((F.col(f"bm25_{t}") for t in topics), F.lit(0.0)) / len(topics))


def resolved_language(df: DataFrame, lang: str, available: list[str], fallback: dict[str, str]) -> DataFrame:
    """``df`` with ``resolved``: the exact code, else its fallback if that is available, else null."""
    c = F.when(F.col(lang).isin(available), F.col(lang))
    for a, z in fallback.items():
        if z in available:
            c = c.when(F.col(lang) == a, F.lit(z))
    return df.withColumn("resolved", c)


def folder_name(url: Column) -> Column:
    """Host of a URL as a folder name: lower case, without one ``www.``, dots as underscores; empty without a scheme."""
    host = F.regexp_extract(F.regexp_replace(F.trim(url), "/+$", ""), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#]*@)?([^/?#:]*)", 1)
    return F.replace(F.regexp_replace(F.lower(host), r"^www\.", ""), F.lit("."), F.lit("_"))


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def unicode_trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^(?U)[\s\x1c-\x1f]+|(?U)[\s\x1c-\x1f]+$", "")
