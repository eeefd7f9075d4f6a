"""Text read under a wrong character encoding (problem 10): best-first search for the cheapest reachable text.

Every token (a run without blanks) that isn't plain ASCII is the start of a graph whose edges undo one wrong reading (encode
with the codec it was read by, decode with the one it was written in) or one escape. States are visited once (hash set)
and expanded in the order of their cost: how implausible the characters and their neighbours are, plus what the edges taken
so far cost. A way leads through texts each cheaper than the one before, edges included; so the search ends by itself,
without a limit on steps or states. What can't be cheaper is told from the bytes before a text is even decoded, as no
character costs less than its kind's least.
A long token is searched in parts, cut where no reading has a character going on (before the character of a lead byte or
an ASCII one; a token without such a place stays whole), so that each part comes out as it would within the whole. A token is garbled if a text at the end of at least one reading is clearly cheaper than the token. Each distinct
token is searched once per worker (bounded cache).

Replacement characters and C1 controls result from a wrong reading by themselves, restorable or not. Character entities,
emoji, foreign scripts and accented capitals aren't cases: no reading leads from them to cheaper text.
Defined results: null and empty texts are never cases and are returned as they are; null keys have rows like others.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrow import arrow_map

# Codecs texts are wrongly read by, and codecs they are written in.
READ_BY = ["cp1252", "latin-1", "cp1251", "cp437", "cp850", "mac_roman", "gb18030", "cp1250", "iso8859-15", "koi8-r", "cp866", "big5", "shift_jis"]
WRITTEN_IN = {"utf-8": 0.5, "cp1251": 5.0, "gbk": 5.0, "cp1252": 7.0, "koi8-r": 6.0, "mac_roman": 7.0, "cp850": 7.0}
#: Cheaper steps: confusions that are common and leave a plain trace.
CHEAP = {("mac_roman", "cp1252"): 2.8, ("cp850", "cp1252"): 2.8, ("cp437", "cp1252"): 2.8, ("cp1251", "cp1252"): 4.0, ("cp1251", "koi8-r"): 3.0, ("koi8-r", "cp1251"): 3.0, ("gb18030", "cp1252"): 4.0,
         ("cp1252", "mac_roman"): 4.0, ("cp1252", "cp850"): 4.0, ("latin-1", "cp1252"): 2.0}
#: So much cheaper than the token a text must be.
MARGIN = 0.6
#: Remembered tokens, and the longest of them; a part is cut at the first safe place after so many characters.
CACHE, LONGEST, PART = 200_000, 64, 64

_COMMON = set("àáâãäçèéêëìíîïñòóôõöùúûüßœæ")
_COMMON_UP = {c.upper() for c in _COMMON if len(c.upper()) == 1}
_PRINT = set("“”‘’–—…«»„•°²³½·¿¡€£©®™‚′″₂ №§")
_HAN_MARKS = set("，。：；？！（）、《》【】「」“”…—·％")


def _sloppy(codec: str):
    """Encoder of single-byte codecs that passes undefined bytes as C1 controls, as lenient readers do."""
    table = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        table.setdefault(c, b)
    for b in range(128, 160):
        table.setdefault(chr(b), b)
    return table


_SINGLE = {c: _sloppy(c) for c in READ_BY if c not in ("gb18030", "big5", "shift_jis")}


def _encode(text: str, codec: str) -> bytes | None:
    table = _SINGLE.get(codec)
    if table is not None:
        try:
            return bytes([table[c] for c in text])
        except KeyError:
            return None
    try:
        return text.encode(codec)
    except UnicodeEncodeError:
        return None


@lru_cache(maxsize=100_000)
def char_cost(c: str) -> float:
    o = ord(c)
    if o < 127:
        return 0.2 if o >= 32 or c in "\t\n\r" else 8.0
    if c in _COMMON:
        return 1.5
    if c in _COMMON_UP:
        return 2.5
    if c in _PRINT:
        return 2.0
    if "а" <= c <= "я" or "А" <= c <= "Я" or c in "ёЁ":
        return 1.0
    if c in _HAN_MARKS:
        return 1.5
    if 0x4E00 <= o <= 0x9FFF:
        try:
            return 1.5 if 0xB0 <= c.encode("gb2312")[0] <= 0xD7 else 4.5
        except UnicodeEncodeError:
            return 6.0
    if o < 160 or c == "�":
        return 12.0
    k = unicodedata.category(c)
    if k in ("Cn", "Co", "Cs"):
        return 12.0
    if o in (0xA0, 0xAD):
        return 3.0
    if 0x1F000 <= o or o == 0x200D:
        return 2.0
    if k[0] == "L":
        if o < 0x250:
            return 5.0
        if 0x400 <= o < 0x530:
            return 5.0
        if 0x370 <= o < 0x400:
            return 3.5
        if 0x590 <= o < 0x10A0 or 0x3040 <= o < 0x3100 or 0xAC00 <= o < 0xD7A4:
            return 2.0 if unicodedata.name(c, "").split(" ")[0] in ("ARABIC", "HEBREW", "DEVANAGARI", "THAI", "HIRAGANA", "KATAKANA", "HANGUL", "BENGALI", "TAMIL") else 8.0
        return 6.0
    return 3.0 if k[0] == "M" else 6.0


@lru_cache(maxsize=100_000)
def script(c: str) -> str:
    """L(atin), C(yrillic), H(an), G(reek), X (other letter) or empty."""
    o = ord(c)
    if o < 128:
        return "L" if c.isalpha() else ""
    if not c.isalpha():
        return ""
    if o < 0x250:
        return "L"
    return "G" if 0x370 <= o < 0x400 else "C" if 0x400 <= o < 0x530 else "H" if 0x2E80 <= o < 0xA000 else "X"


class _Chars(dict):
    """What ``cost`` asks of a character, worked out once."""

    def __missing__(self, c: str):
        s = script(c)
        got = self[c] = (char_cost(c), s, c.islower(), c.isupper(), s == "L" and ord(c) > 127)
        return got


_known_char = _Chars().__getitem__
#: Accented letters that are no word by themselves in the languages of the corpus.
_NEVER_ALONE = set("ûñïîìíëùåøþðæâãõÿüúçòËÏÛÑÎÌÍÙÅÆÂÃÕÜÚÇÒ")
#: Places where a common accented letter doesn't stand in the words of these languages: what is there instead was read wrongly.
_MISPLACED = re.compile(
    "(?<=[^\\W\\d_])(?!(?<=l)·l)[\u00a1-\u00bf\u2018\u201a-\u201f\u2020-\u2022\u2030-\u203a](?=[^\\W\\d_])"  # a sign inside a word, other than an apostrophe or dash
    "|(?<=[^\\W\\d_])[À-ÖØ-Þ](?=[a-z])"  # a capital inside a word
    "|[^\\W\\d_]{3}(?<!all)[îôûñâõ](?![^\\W\\d_])"  # at its end
    "|[.,!?][À-ÖØ-öø-ÿ](?![^\\W\\d_])|(?<=[^\\W\\d_])[¡¿]"  # a lone letter after a stop, an opening mark after a letter
    "|õ(?![es])|[bcdfghjklmnpqrtvwxz]sí(?![^\\W\\d_])|[^\\W\\d_]{4}[bcdfghjklmnpqrtvwxz]ís(?![^\\W\\d_])"
)
_LATIN = re.compile("[A-Za-zÀ-ÿ]")
_HIGH = bytes(range(128, 256))


def least_cost(raw: bytes, codec: str) -> float:
    """Less than which no text costs that ``raw`` decodes to."""
    low = len(raw.translate(None, _HIGH))
    return 0.2 * low + (len(raw) - low) * (0.5 if codec == "utf-8" else 0.75 if codec == "gbk" else 1.0)


def cost(text: str) -> float:
    """How implausible a token is: its characters, changes of script and case inside words, rows of accented letters."""
    total, row, last, low_start = 0.0, 0, "", False
    if not text.isascii():
        if len(text) == 1 and text in _NEVER_ALONE:
            total = 5.0
        elif _LATIN.search(text):
            total = 4.0 * len(_MISPLACED.findall(text))
    last_s, last_lower = "", False
    for c in text:
        price, s, lower, upper, accented = _known_char(c)
        total += price
        if last:
            if s and last_s and s != last_s:
                total += 6.0 if s != "H" != last_s else 3.0
            elif s and last_s and s != "H" and last_lower and upper:
                total += 4.0
                low_start = True
            elif low_start and upper and s == "C":
                total += 1.5
            elif not s:
                low_start = False
        if accented:
            row += 1
            if row >= 3:
                total += 3.0
        else:
            row = 0
        last, last_s, last_lower = c, s, lower
    return total


_PRICES = {by: [(codec, CHEAP.get((by, codec), price)) for codec, price in WRITTEN_IN.items() if codec != by] for by in READ_BY}


def _steps(text: str, most: float, dearest: float = 1e9):
    """Texts one wrong reading or escape away, with the cost of the step and whether it is a reading.

    Only those that may cost less than ``most`` in all, by steps that cost less than ``dearest``.
    """
    if "&" in text and (u := html.unescape(text)) != text:
        yield u, 1.0, False
    if text.isascii():
        return
    for by in READ_BY:
        raw = _encode(text, by)
        if raw is None:
            continue
        for codec, price in _PRICES[by]:
            if (codec in ("cp1252", "cp850", "mac_roman") and by in ("latin-1", "iso8859-15") and not any(128 <= x < 160 for x in raw)):
                continue
            if price >= dearest or price + least_cost(raw, codec) >= most:
                continue
            try:
                out = raw.decode(codec)
            except UnicodeDecodeError:
                continue
            if out != text:
                yield out, price, True


def restore(token: str) -> str | None:
    """The cheapest text behind a garbled token; None where the token isn't garbled."""
    start = cost(token)
    best, found = start - MARGIN, None
    heap, seen, tick = [(start, 0, token, 0.0, False)], {token: 0.0}, 0
    while heap:
        whole, _, text, paid, read = heapq.heappop(heap)
        if paid >= best or paid > seen[text]:
            continue
        for out, price, reading in _steps(text, whole - paid, best - paid):
            now = paid + price
            if now >= min(best, seen.get(out, best)):
                continue
            c = cost(out) + now
            if c >= whole:
                continue
            seen[out] = now  # a text is visited again only by a cheaper way
            # what an escape alone gains doesn't count: the reading must pay for itself
            if (read or reading) and c < best:
                best, found = c, out
            tick += 1
            heapq.heappush(heap, (c, tick, out, now, read or reading))
    return found


_SURE = re.compile("[\\x80-\\x9f�]")
_TOKEN = re.compile(r"[^ \t\n\r]+")
_HAN_RUN = re.compile("[^\\x00-\\x7f，。：；？！（）“”]{2,}")
_HAN = re.compile("[\\u3400-\\u9fff]")

_known: dict[str, str] = {}


def _han_readings(text: str) -> list[tuple[int, int, str]]:
    """Runs of Han text that are UTF-8 read as a Chinese codec."""
    out = []
    for m in _HAN_RUN.finditer(text):
        run = m.group()
        for codec in ("gb18030", "big5"):
            try:
                back = run.encode(codec).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
            if cost(back) + WRITTEN_IN["utf-8"] < cost(run) - MARGIN:
                out.append((*m.span(), back))
                break
    return out


def _token_text(token: str) -> str:
    """A token with its garbled parts restored; text without blanks is taken from one stop to the next."""
    got = _known.get(token)
    if got is None:
        got = token
        got = "".join((_restored(x) or x) if not x.isascii() or "&" in x else x for x in _parts(token))
        if _HAN.search(got):
            for a, b, back in reversed(_han_readings(got)):
                got = got[:a] + back + got[b:]
        if len(token) <= LONGEST:
            if len(_known) >= CACHE:
                _known.clear()
            _known[token] = got
    return got


_STOPS = re.compile("([，。])")
_restored = lru_cache(maxsize=20_000)(restore)


@lru_cache(maxsize=100_000)
def _safe_before(c: str) -> bool:
    """Whether no single-byte reading makes ``c`` the continuation of a character."""
    return c.isascii() or not any(0x80 <= t[c] < 0xC0 for t in _SINGLE.values() if c in t)


def _parts(token: str) -> list[str]:
    """Pieces of a token, which together are the token."""
    out = []
    for x in _STOPS.split(token):
        while len(x) > PART:
            end = next((i for i in range(PART, len(x)) if _safe_before(x[i])), len(x))
            out.append(x[:end])
            x = x[end:]
        out.append(x)
    return out


def changes(text: str) -> dict[str, str]:
    """Garbled tokens of a text and what they come out as; each distinct token is looked at once."""
    if text.isascii() and "&" not in text:
        return {}
    words = set(text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))
    return {w: t for w in words if (not w.isascii() or "&" in w) and (t := _token_text(w)) != w}


def garbled(text: str) -> bool:
    return bool(_SURE.search(text) or changes(text))


def restored_text(text: str) -> str:
    """The text with every garbled token restored as far as it can be."""
    new = changes(text)
    return _TOKEN.sub(lambda m: new.get(m.group(), m.group()), text) if new else text


def p10_found(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id) of documents in which at least one character results from a wrong reading."""
    kind = dict(documents.dtypes)[key]

    def run(b: pa.RecordBatch):
        rows = [i for i, t in enumerate(b["t"].to_pylist()) if garbled(t)]
        return {"doc_id": b["k"].take(pa.array(rows, pa.int64()))}

    return arrow_map(documents.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null"), run, f"doc_id {kind}").dropDuplicates()


def p10_restored(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, changed): every document with its text restored as far as it can be."""
    kind = dict(documents.dtypes)[key]

    def run(b: pa.RecordBatch):
        old = b["t"].to_pylist()
        new = [restored_text(t) if t else t for t in old]
        return {"doc_id": b["k"], "text": new, "changed": [x != y for x, y in zip(old, new)]}

    return arrow_map(documents.select(F.col(key).alias("k"), F.col(text).alias("t")), run, f"doc_id {kind}, text string, changed boolean")
