"""Visually identical text with different characters (problem 7).

``canonical`` brings a text to compatibility-composed form with mapped white space, without default-ignorable characters
and with look-alike letters of another script inside a word mapped to the word's script; ``comparable`` adds full case
folding. Arrow kernels find the values that hold anything but plain characters and the distinct ones among them; each of
these is worked out once. ``p7_consistent`` gives both forms: one to read, one to compare by.

A field is a case if bringing it to the form changes a character that counts: typographic quotes, dashes, ellipses,
bullets, U+FFFD, Chinese punctuation, super- and subscripts and whole words in another script don't.
Defined results: null and empty fields are never cases and stay as they are; copies of a row give one row.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrow import arrow_map

# Letters of other scripts that look like Latin ones, and the Latin letters they look like.
CYRILLIC = dict(zip("аеорсухѕіјһԁԛԝӏАВЕКМНОРСТУХЅІЈԌѴ", "aeopcyxsijhdqwlABEKMHOPCTYXSIJGV"))
GREEK = dict(zip("οναρυιΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ovapuiABEZHIKMNOPTYX"))
OTHER = dict(zip("օսոհցյɑɡ", "ounhgjag"))
TO_LATIN = CYRILLIC | GREEK | OTHER
TO_CYRILLIC = {v: k for k, v in dict(zip("аеорсухАВЕКМНОРСТУХ", "aeopcyxABEKMHOPCTYX")).items()}
#: Punctuation usual in Chinese and in print: kept as it is though a compatibility form exists.
KEPT = set("，。：；？！（）「」『』【】《》〈〉、～…‥“”‘’‚„‛‟«»‹›–—―‒−•·‣⁃′″‴�％＋－／＝＆＠＃＊｜￥")
_SCRIPTS = {"LATIN": "L", "CYRILLIC": "C", "GREEK": "G"}


def ignorable(c: str) -> bool:
    """Shows nothing: default-ignorable code points and controls other than tab and line ends."""
    o = ord(c)
    if c in "\t\n\r":
        return False
    return (
        o == 0xAD or o == 0x34F or o == 0x61C or 0x115F <= o <= 0x1160 or 0x17B4 <= o <= 0x17B5 or 0x180B <= o <= 0x180F or 0x200B <= o <= 0x200F
        or 0x202A <= o <= 0x202E or 0x2060 <= o <= 0x206F or o == 0x3164 or 0xFE00 <= o <= 0xFE0F or o == 0xFEFF or o == 0xFFA0 or 0xFFF9 <= o <= 0xFFFB
        or 0xE0000 <= o <= 0xE0FFF or o < 32 or 127 <= o < 160
    )


def plain_of(c: str) -> str:
    """The usual code of one character, itself where it is the usual one."""
    if c in KEPT or c in "\t\n\r":
        return c
    if ignorable(c):
        return ""
    if c in "\u2010\u2011":  # hyphens that look like the usual one
        return "-"
    if unicodedata.category(c) in ("Zs", "Zl", "Zp"):
        return " "
    if unicodedata.decomposition(c).startswith(("<super>", "<sub>", "<fraction>", "<circle>")):
        return c
    return unicodedata.normalize("NFKC", c)


@lru_cache(maxsize=1)
def _tables():
    """Translation of the characters that aren't the usual code, the set of them, and the set of combining marks."""
    every = [chr(o) for o in range(sys.maxunicode + 1) if not 0xD800 <= o < 0xE000]
    table = {ord(c): p for c in every if (p := plain_of(c)) != c}
    return table, frozenset(map(chr, table)), frozenset(c for c in every if unicodedata.combining(c))


_NEAR = frozenset(TO_LATIN)
_WORD = re.compile(r"[^\W\d_]+")
_LATIN, _FOREIGN = re.compile("[A-Za-zÀ-ɏ]"), re.compile("[Ѐ-ԯͰ-Ͽ\u0530-\u058fɑɡ]")
_CYR_OWN = re.compile("[бвгджзийклмнптфцчшщъыьэюяБГДЖЗИЙЛПФЦЧШЩЪЫЬЭЮЯёЁ]")


def one_script(word: str) -> str:
    """A word of mixed look-alike scripts in the script of its other letters; other words as they are."""
    if not (_LATIN.search(word) and _FOREIGN.search(word)):
        return word
    if _CYR_OWN.search(word):
        return "".join(TO_CYRILLIC.get(c, c) for c in word)
    return "".join(TO_LATIN.get(c, c) for c in word)


def canonical(text: str) -> str:
    """Consistent form of one text; equal to the text where nothing needs changing."""
    table, odd, marks = _tables()
    seen = set(text)
    s = text if seen.isdisjoint(odd) else text.translate(table)
    if not seen.isdisjoint(marks):
        s = unicodedata.normalize("NFC", s)
    if not seen.isdisjoint(_NEAR) and _LATIN.search(s):
        s = _WORD.sub(lambda m: one_script(m.group()), s)
    return s


def comparable(text: str) -> str:
    """Canonical form with full case folding, for comparing."""
    return unicodedata.normalize("NFC", canonical(text).casefold())


def changed(values: pa.Array, fn) -> tuple[np.ndarray, list[str]]:
    """(rows, new texts) of the values that ``fn`` changes, worked out once per distinct value; texts of plain characters aren't looked at.

    ``fn`` must leave printable ASCII, tabs and line ends as they are.
    """
    odd = np.flatnonzero(pc.fill_null(pc.match_substring_regex(values, r"[^\x20-\x7e\t\n\r]"), False).to_numpy(zero_copy_only=False))
    one = values.take(pa.array(odd)).dictionary_encode()
    old = one.dictionary.to_pylist()
    new = [fn(v) for v in old]
    other = np.array([a != b for a, b in zip(old, new)], bool)
    which = one.indices.to_numpy(zero_copy_only=False)
    hit = other[which] if len(which) else np.zeros(0, bool)
    return odd[hit], [new[k] for k in which[hit].tolist()]


def p7_found(articles: DataFrame) -> DataFrame:
    """(id, field_name) of the fields that aren't in the consistent form."""
    src = articles.where("id is not null").select("id", "title", "content")

    def run(b: pa.RecordBatch):
        per = {name: changed(b[name], canonical)[0] for name in ("title", "content")}
        rows = np.concatenate(list(per.values())).astype(np.int64)
        return {"id": b["id"].take(pa.array(rows)), "field_name": [name for name, r in per.items() for _ in r]}

    return arrow_map(src, run, "id string, field_name string").dropDuplicates()


def _put(values: pa.Array, rows: np.ndarray, new: list[str]) -> pa.Array:
    mask = np.zeros(len(values), bool)
    mask[rows] = True
    return pc.replace_with_mask(values, pa.array(mask), pa.array(new, values.type))


def consistent(df: DataFrame, columns: list[str], folded: str | None = None) -> DataFrame:
    """``df`` with the named text columns in consistent form; ``folded``: and, with this suffix, in the form for comparing.

    Folding plain texts is left to an Arrow kernel, as lower case and full folding agree on ASCII.
    """
    fields = df.schema.fields
    names = [f.name for f in fields]

    def run(b: pa.RecordBatch):
        out = {c: b[c] for c in names}
        for c in columns:
            out[c] = _put(b[c], *changed(b[c], canonical))
            if folded:
                out[c + folded] = _put(pc.ascii_lower(b[c]), *changed(b[c], comparable))
        return out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + "".join(f", `{c}{folded}` string" for c in columns if folded)
    return arrow_map(df, run, schema)
