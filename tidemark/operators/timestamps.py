"""Written instants in many forms and zones -> one UTC instant (problem 2).

A value's *shape mask* is the value with each digit replaced by ``9`` and white space collapsed; masks are made for a whole
batch by Arrow kernels. Each distinct mask is tokenised once (words become the mark of their class: month, am/pm, zone,
connector) and mapped to a parser: the places of year, month, day and so on among its digits. All values of a mask
are then converted together with numpy, from their digits alone. Wall clock times go through tables of zone transitions
read from the tz database's own files, with the rule at their end for all later years; ``p2_zones`` reports the version.

Defined results: null, blank or unreadable values, values without a time of day, wall clock times that occur twice or
never in their zone, and zoneless values without a known zone give null. Day/month order follows the locale;
where no locale is known, only an order-free reading counts. Columns of the input other than those named are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zoneinfo
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrow import arrow_map

# Month names of the eight languages of the corpus, by month.
MONTHS = [
    "january jan januar janeiro janvier janv gennaio gen enero ene января январь янв jän",
    "february feb februar fevereiro février févr fev fév febbraio febrero февраля февраль фев",
    "march mar märz mär março mars marzo марта март мар mrz",
    "april apr abril abr avril avr aprile апреля апрель апр",
    "may mai maio mayo maggio mag мая май",
    "june jun juni junho juin giugno giu junio июня июнь июн",
    "july jul juli julho juillet juil luglio lug julio июля июль июл",
    "august aug agosto ago août aou августа август авг",
    "september sep sept setembro set septembre settembre septiembre сентября сентябрь сен",
    "october oct oktober okt outubro out octobre ottobre ott octubre октября октябрь окт",
    "november nov novembro novembre noviembre ноября ноябрь ноя",
    "december dec dezember dez dezembro décembre déc dicembre dic diciembre декабря декабрь дек",
]
_MONTH_MARK = "abcdefghijkl"
MONTH = {w: m for m, ws in enumerate(MONTHS, 1) for w in ws.split()}
WEEKDAY = set("mon tue wed thu fri sat sun monday tuesday wednesday thursday friday saturday sunday mo di mi do fr sa so lun mar mer jeu ven sam dim".split())
CONNECTOR = set("de del at à às a ore uhr um le el kl в г года den il alle las".split())
# Offsets in minutes of zone abbreviations that don't depend on the reader.
ABBREVIATION = {
    "GMT": 0, "UTC": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
    "BRT": -180, "ART": -180, "COT": -300, "IST": 330, "SGT": 480, "HKT": 480, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600,
    "AEDT": 660, "NZST": 720, "NZDT": 780, "EAT": 180, "WAT": 60, "CAT": 120, "SAST": 120, "KGT": 360,
}
#: Locales of month-first numeric dates.
MONTH_FIRST = {"en-US"}

_WORD = re.compile(r"[^\W\d_]+")
_AMPM = re.compile(r"(?i)(?<![^\W\d_])([ap])\.?\s?m\.?(?![^\W\d_])")
#: The calendar repeats after so many years and days; rules are written out for one such cycle.
CYCLE_YEARS, CYCLE = 400, 146_097 * 86_400


def _zone_file(zone: str) -> bytes:
    """The tz database's file of a zone: of the system, else of the ``tzdata`` package."""
    if not re.fullmatch(r"[A-Za-z0-9_+-]+(?:/[A-Za-z0-9_+-]+)*", zone):
        raise ValueError(zone)
    for folder in zoneinfo.TZPATH:
        path = os.path.join(folder, *zone.split("/"))
        if os.path.isfile(path):
            with open(path, "rb") as f:
                return f.read()
    from importlib import resources

    return resources.files("tzdata").joinpath("zoneinfo", *zone.split("/")).read_bytes()


@lru_cache(maxsize=1)
def tz_version() -> str:
    """Version of the tz database the tables are made from."""
    for folder in zoneinfo.TZPATH:
        for name, pattern in (("+VERSION", r"(\d{4}[a-z]+)"), ("tzdata.zi", r"version (\S+)")):
            path = os.path.join(folder, name)
            if os.path.isfile(path):
                with open(path) as f:
                    if m := re.search(pattern, f.readline()):
                        return m.group(1)
        if os.path.isdir(folder):
            return "system"
    import tzdata

    return tzdata.IANA_VERSION


def _zone_data(raw: bytes):
    """(transition times, offset after each, offset before the first, abbreviation of each offset, trailing rule) of a file in TZif form."""
    size = struct.Struct(">4sc15x6l")
    magic, version, *n = size.unpack_from(raw)
    if magic != b"TZif":
        raise ValueError("no tz file")
    at, wide = size.size, 4
    if version >= b"2":  # the second block holds the same with 64-bit times
        utc, std, leap, times, types, chars = n
        at += times * 5 + types * 6 + chars + leap * 8 + std + utc
        _, _, *n = size.unpack_from(raw, at)
        at, wide = at + size.size, 8
    utc, std, leap, times, types, chars = n
    when = np.frombuffer(raw, ">i8" if wide == 8 else ">i4", times, at).astype(np.int64)
    index = np.frombuffer(raw, np.uint8, times, at + times * wide)
    at += times * (wide + 1)
    kinds = [struct.unpack_from(">lBB", raw, at + 6 * k) for k in range(types)]
    names = raw[at + 6 * types : at + 6 * types + chars]
    end = at + 6 * types + chars + leap * (wide + 4) + std + utc
    rule = raw[end:].strip(b"\n").decode() if wide == 8 else ""
    offsets = np.array([k[0] for k in kinds], np.int64)
    # abbreviations in use since 1970, of several meanings the latest
    since = max(0, int(np.searchsorted(when, 0, "right")) - 1)
    abbr = {names[k[2] : names.index(b"\0", k[2])].decode(): k[0] for k in ([kinds[i] for i in index[since:].tolist()] or kinds[:1])}
    return when, offsets[index], int(offsets[0]), abbr, rule


_RULE = re.compile(r"(<[^>]+>|[A-Za-z]{3,})([+-]?[\d:]+)(?:(<[^>]+>|[A-Za-z]{3,})([+-]?[\d:]+)?,([^,/]+)(?:/([+-]?[\d:]+))?,([^,/]+)(?:/([+-]?[\d:]+))?)?$")


def _seconds(text: str) -> int:
    sign = -1 if text.startswith("-") else 1
    h, m, s, *_ = [int(x) for x in text.lstrip("+-").split(":")] + [0, 0]
    return sign * (h * 3600 + m * 60 + s)


def _rule_days(rule: str, years: np.ndarray) -> np.ndarray:
    """Days since 1970 on which a rule such as ``M3.2.0``, ``J60`` or ``59`` falls in each year."""
    start = (np.char.zfill(years.astype(str), 4)).astype("datetime64[Y]").astype("datetime64[D]").astype(np.int64)
    leap = (years % 4 == 0) & ((years % 100 != 0) | (years % 400 == 0))
    if rule.startswith("J"):
        n = int(rule[1:])
        return start + n - 1 + (leap & (n > 59))
    if not rule.startswith("M"):
        return start + int(rule)
    month, week, weekday = map(int, rule[1:].split("."))
    before = np.array([0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334])[month - 1] + (leap & (month > 2))
    length = np.array([31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[month - 1] + (leap & (month == 2))
    first = start + before
    day = (weekday - (first + 4) % 7) % 7 + 7 * (week - 1)  # 1970-01-01 was a Thursday
    return first + np.where(day >= length, day - 7, day)


class ZoneTable:
    """Transitions of one zone and the abbreviations it uses, from tz database ``version``.

    Before the first transition the zone's first offset holds; after the last one the trailing rule, written out for
    one cycle of the calendar, into which later times are mapped.
    """

    def __init__(self, zone: str):
        self.version = tz_version()
        at, after, before, abbr, rule = _zone_data(_zone_file(zone))
        self.cyclic = False
        self.abbr = {k: v for k, v in abbr.items() if k.isalpha() and k != "LMT"}
        m = _RULE.match(rule)
        if m:
            std, std_off, dst, dst_off, *_ = m.groups()
            standard = -_seconds(std_off)
            if std.isalpha():
                self.abbr[std] = standard
            if dst:
                summer = -_seconds(dst_off) if dst_off else standard + 3600
                if dst.isalpha():
                    self.abbr[dst] = summer
                first = 1970 if not len(at) else int(at[-1].astype("datetime64[s]").astype("datetime64[Y]").astype(int)) + 1970
                years = np.arange(first, first + 2 * CYCLE_YEARS + 2)
                on = _rule_days(m.group(5), years) * 86_400 + _seconds(m.group(6) or "2") - standard
                off = _rule_days(m.group(7), years) * 86_400 + _seconds(m.group(8) or "2") - summer
                more = np.concatenate([on, off])
                offs = np.repeat([summer, standard], len(years))
                order = np.argsort(more, kind="stable")
                more, offs = more[order], offs[order]
                self.cyclic = True
                late = more > at[-1] if len(at) else np.ones(len(more), bool)
                at, after = np.concatenate([at, more[late]]), np.concatenate([after, offs[late]])
        self.at = at
        self.offsets = np.concatenate([[before], after]).astype(np.int64)
        #: Up to here the table is complete, and the cycle before holds the rule alone.
        self.last = int(at[-1]) - 2 * 366 * 86_400 if self.cyclic else 0

    def to_utc(self, wall: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Seconds of UTC for wall clock seconds; whether exactly one instant has that wall clock time."""
        back = np.maximum(0, -(-(wall - self.last) // CYCLE)) * CYCLE if self.cyclic else np.zeros(len(wall), np.int64)
        wall = wall - back
        n, found, out = np.zeros(len(wall), np.int64), np.zeros(len(wall), np.int64), np.zeros(len(wall), np.int64)
        k = np.searchsorted(self.at, wall, "right")
        for d in (-1, 0, 1):
            i = np.clip(k + d, 0, len(self.offsets) - 1)
            utc = wall - self.offsets[i]
            fits = (np.searchsorted(self.at, utc, "right") == i) & (i == k + d)
            out = np.where(fits & (found == 0), utc, out)
            found += fits
            n += fits
        return out + back, n == 1


@lru_cache(maxsize=1024)
def zone_table(zone: str) -> ZoneTable | None:
    try:
        return ZoneTable(zone)
    except (ModuleNotFoundError, ValueError, OSError, struct.error):
        return None


def template(mask: str) -> tuple[str, str, int]:
    """The mask with words replaced by class marks (months by ``Ma`` to ``Ml``); the zone abbreviation; am/pm (0 none, 1 am, 2 pm)."""
    half, zone = 0, ""
    s = mask.strip()
    if not s:
        return "", "", 0
    m = _AMPM.search(s)
    if m:
        half = 1 if m.group(1).lower() == "a" else 2
        s = s[: m.start()].rstrip() + s[m.end() :]

    def word(w: re.Match) -> str:
        nonlocal zone
        x = w.group()
        low = x.lower()
        if low in MONTH:
            before = s[: w.start()].rstrip()
            if not (low == "mar" and s[w.end() : w.end() + 1] == "," and not before):
                return "M" + _MONTH_MARK[MONTH[low] - 1]
        if low in WEEKDAY and not s[: w.start()].strip():
            return "\x01"
        if low in CONNECTOR:
            return "\x01"
        if low == "h" and w.start() and s[w.start() - 1].isdigit():
            return ":"
        if x in ("T", "t"):
            return "T"
        if x in ("Z", "z"):
            return "Z"
        if x in "年月":
            return "-" if x == "年" else "-"
        if x == "日":
            return " "
        if x.upper() == x and 2 <= len(x) <= 5 and s[w.end() :].strip() == "":
            zone = x
            return "\x02"
        return "\x03"

    s = _WORD.sub(word, re.sub("([年月日])", r" \1 ", s) if "年" in s else s)
    if "\x03" in s:
        return "", "", 0
    s = re.sub(r"\s*-\s+|\s+-\s*(?=\d{1,2}\s+-)", "-", s) if "年" in mask else s
    s = re.sub(r"[\x01\s]+(?:[,.][\x01\s]*)?", " ", s.replace("\x01.", " ")).strip().lstrip(",").strip()
    s = re.sub(r",\s*", " ", s)
    s = re.sub(r"(\d)\.\s+(?=M)", r"\1 ", s)
    s = re.sub(r"(M[a-l])\.", r"\1", s)
    s = re.sub(r"\s*\x02$", "\x02", s)
    return re.sub(r"\s+", " ", s), zone, half


_TIME = r"(?P<h>9{1,2}):(?P<mi>99)(?::(?P<s>99)(?:[.,](?P<f>9{1,12}))?)?"
_ZONE = r"(?P<z> ?Z|\x02| ?(?P<sg>[+-])(?P<zh>99)(?::?(?P<zm>99))?)?"
_LAYOUTS = [
    (re.compile(rf"^(?P<y>9999)[-/](?P<m>9{{1,2}})[-/](?P<d>9{{1,2}})[T ]{_TIME}{_ZONE}$"), "ymd"),
    (re.compile(r"^(?P<y>9999)(?P<m>99)(?P<d>99)T(?P<h>99)(?P<mi>99)(?P<s>99)" + _ZONE + "$"), "ymd"),
    (re.compile(rf"^(?P<a>9{{1,2}})(?P<sep>[/.-])(?P<b>9{{1,2}})(?P=sep)(?P<y>9999) {_TIME}{_ZONE}$"), "num"),
    (re.compile(rf"^(?P<d>9{{1,2}}) M(?P<w>[a-l]) (?P<y>9999) {_TIME}{_ZONE}$"), "ymd"),
    (re.compile(rf"^M(?P<w>[a-l]) (?P<d>9{{1,2}}) (?P<y>9999) {_TIME}{_ZONE}$"), "ymd"),
    (re.compile(r"^(?P<e>9{9,10})(?:\.(?P<f>9{1,12}))?$"), "s"),
    (re.compile(r"^(?P<e>9{13})$"), "ms"),
    (re.compile(r"^(?P<e>9{16})$"), "us"),
]


def layout(form: str) -> tuple[str, dict[str, tuple[int, int]], dict[str, str]] | None:
    """(kind, places of the slots among the digits, slots that are no digits) of a template; None where no written form fits it."""
    for pattern, kind in _LAYOUTS:
        m = pattern.match(form)
        if m:
            got = {k: (v, m.span(k)) for k, v in m.groupdict().items() if v is not None}
            nth = lambda i: form.count("9", 0, i)
            digits = {k: (nth(a), nth(b)) for k, (v, (a, b)) in got.items() if v.strip("9") == ""}
            return kind, digits, {k: v for k, (v, _) in got.items() if v.strip("9")}
    return None


@lru_cache(maxsize=50_000)
def _parser(mask: str):
    form, zone, half = template(mask)
    known = layout(form) if form else None
    return None if known is None else (*known, zone, half)


def parser(mask: str):
    """What reads a mask: (kind, places, other slots, zone abbreviation, am/pm), or None. Only masks that may come again are remembered."""
    return _parser(mask) if len(mask) <= 100 else _parser.__wrapped__(mask)


def _days(y, m, d):
    """Days since 1970 of proleptic Gregorian dates; whether the date exists."""
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    length = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.clip(m, 0, 12)] + (leap & (m == 2))
    ok = (m >= 1) & (m <= 12) & (d >= 1) & (d <= length) & (y >= 1)
    base = (np.char.add(np.char.zfill(y.astype(str), 4), "-01-01")).astype("datetime64[D]").astype(np.int64)
    start = np.array([0, 0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334])[np.clip(m, 0, 12)] + (leap & (m > 2))
    return base + start + d - 1, ok


def normalise(values, zones, locales) -> tuple[np.ndarray, np.ndarray]:
    """Microseconds of UTC and validity for text, zone name and locale (lists or Arrow arrays; None where unknown)."""
    values = pc.cast(values if isinstance(values, pa.Array) else pa.array(values, pa.string()), pa.string())
    n = len(values)
    out, good = np.zeros(n, np.int64), np.zeros(n, bool)
    if not n:
        return out, good
    masks = pc.replace_substring_regex(pc.replace_substring_regex(values, r"[0-9]", "9"), r"[\pZ\t\n\v\f\r\x{1c}-\x{1f}\x{85}]+", " ").dictionary_encode()
    digits = pc.replace_substring_regex(values, r"[^0-9]+", "")
    zones, locales = ((x if isinstance(x, pa.Array) else pa.array(x, pa.string())).dictionary_encode() for x in (zones, locales))
    code = [pc.fill_null(x.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) for x in (masks, zones, locales)]
    key = (code[0] * (len(zones.dictionary) + 1) + code[1] + 1) * (len(locales.dictionary) + 1) + code[2] + 1
    order = np.argsort(key, kind="stable")
    edges = np.flatnonzero(np.diff(key[order], prepend=key[order[0]] - 1, append=key[order[-1]] + 1))
    for a, b in zip(edges, edges[1:]):
        rows = order[a:b]
        mask = code[0][rows[0]]
        known = parser(masks.dictionary[int(mask)].as_py()) if mask >= 0 else None
        if known is None:
            continue
        zone, locale = (d.dictionary[int(c[rows[0]])].as_py() if c[rows[0]] >= 0 else None for d, c in ((zones, code[1]), (locales, code[2])))
        text = np.array(digits.take(pa.array(rows)).to_pylist(), dtype=np.str_)
        width = text.dtype.itemsize // 4
        utc, ok = _convert(*known, text.view(np.uint32).reshape(len(rows), width).astype(np.int64) - 48, zone, locale in MONTH_FIRST if locale else None)
        out[rows], good[rows] = utc, ok
    return out, good


def _convert(kind: str, place: dict, other: dict, abbr: str, half: int, d: np.ndarray, zone: str | None, month_first: bool | None):
    """Microseconds of UTC and validity of values of one mask, from their digits ``d`` [values, digits]."""
    n = len(d)
    none = np.zeros(n, np.int64), np.zeros(n, bool)

    def number(k, default=0):
        if k not in place:
            return np.full(n, default, np.int64)
        a, b = place[k]
        return d[:, a:b] @ (10 ** np.arange(b - a - 1, -1, -1, dtype=np.int64))

    micro = np.zeros(n, np.int64)
    if "f" in place:
        a, b = place["f"]
        part = d[:, a : min(b, a + 6)]
        micro = part @ (10 ** np.arange(5, 5 - part.shape[1], -1, dtype=np.int64))
    if kind in ("s", "ms", "us"):
        return number("e") * {"s": 1_000_000, "ms": 1000, "us": 1}[kind] + micro, np.ones(n, bool)
    y, m, day, h, mi, s = (number(k) for k in ("y", "m", "d", "h", "mi", "s"))
    if "w" in other:
        m = np.full(n, _MONTH_MARK.index(other["w"]) + 1, np.int64)
    ok = np.ones(n, bool)
    if kind == "num":
        a, b = number("a"), number("b")
        dotted = other["sep"] != "/"
        if month_first is None and not dotted:
            ok = (a > 12) ^ (b > 12) | (a == b)
            m, day = np.where(a > 12, b, a), np.where(a > 12, a, b)
        else:
            m, day = (a, b) if month_first and not dotted else (b, a)
    if half:
        ok &= (h >= 1) & (h <= 12)
        h = h % 12 + 12 * (half == 2)
    ok &= (h < 24) & (mi < 60) & (s < 60)
    days, real = _days(y, m, day)
    ok &= real
    wall = days * 86400 + h * 3600 + mi * 60 + s
    z = other.get("z", "").strip()
    if z == "Z":
        utc = wall
    elif z == "\x02":
        t = zone_table(zone) if zone else None
        if t is not None and abbr in t.abbr:
            utc = wall - t.abbr[abbr]
        elif abbr in ABBREVIATION:
            utc = wall - ABBREVIATION[abbr] * 60
        else:
            return none
    elif z:
        zh, zm = number("zh"), number("zm")
        ok &= (zh <= 18) & (zm < 60)
        utc = wall - (-1 if other["sg"] == "-" else 1) * (zh * 3600 + zm * 60)
    else:
        t = zone_table(zone) if zone else None
        if t is None:
            return none
        utc, one = t.to_utc(wall)
        ok &= one
    return utc * 1_000_000 + micro, ok


DONE = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"
OUT = "utc_text string"


def utc_text(df: DataFrame, keep: list[str], value: str = "value", zone: str = "zone", locale: str = "locale") -> DataFrame:
    """``keep`` plus ``utc_text`` (six digits of fraction) for the rows whose value names exactly one instant."""
    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", utc_text string"

    def run(b: pa.RecordBatch):
        us, ok = normalise(b["__v"], b["__z"], b["__l"])
        text = np.datetime_as_string(us.astype("datetime64[us]"), unit="us")
        take = pa.array(np.flatnonzero(ok))
        return {c: b[c].take(take) for c in keep} | {"utc_text": pa.array([t + "Z" for t in text[ok]], pa.string())}

    src = df.select(*keep, F.col(value).alias("__v"), F.col(zone).alias("__z"), F.col(locale).alias("__l"))
    return arrow_map(src, run, schema, rows=20_000)


def written_instants(articles: DataFrame, source_clocks: DataFrame, collector_clocks: DataFrame) -> DataFrame:
    """One row (id, field_name, value, zone, locale) per date field, with the clock it was written by.

    Both clock tables are small dimensions; the planner broadcasts them by their measured size.
    """
    s = source_clocks.select(F.col("source_uri").alias("__s"), F.col("zone_name").alias("__sz"), F.col("locale").alias("__sl")).dropDuplicates(["__s"])
    c = collector_clocks.select(F.col("collection_method").alias("__c"), F.col("zone_name").alias("__cz")).dropDuplicates(["__c"])
    a = articles.select("id", "source_uri", "collection_method", "published_date", "extracted_at")
    a = a.join(s, a.source_uri == s["__s"], "left").join(c, a.collection_method == c["__c"], "left")
    both = F.array(
        F.struct(F.lit("published_date").alias("field_name"), F.col("published_date").alias("value"), F.col("__sz").alias("zone"), F.col("__sl").alias("locale")),
        F.struct(F.lit("extracted_at").alias("field_name"), F.col("extracted_at").alias("value"), F.col("__cz").alias("zone"), F.col("__sl").alias("locale")),
    )
    return a.select("id", F.explode(both).alias("w")).select("id", "w.*").where("value is not null")


def p2_found(articles: DataFrame, source_clocks: DataFrame, collector_clocks: DataFrame) -> DataFrame:
    """Values that name one instant and aren't yet written in the normal form, as UTC text."""
    w = written_instants(articles, source_clocks, collector_clocks).where(~F.col("value").rlike(DONE))
    return utc_text(w, ["id", "field_name"]).dropDuplicates(["id", "field_name", "utc_text"])


def p2_utc(articles: DataFrame, source_clocks: DataFrame, collector_clocks: DataFrame) -> DataFrame:
    """Every readable value of every row as UTC text, those already in normal form included."""
    return utc_text(written_instants(articles, source_clocks, collector_clocks), ["id", "field_name"])


def p2_zones(source_clocks: DataFrame, collector_clocks: DataFrame) -> DataFrame:
    """(zone_name, tz_version, n_transitions, first_year, last_year) of every zone in use; nulls for names the database doesn't know."""
    names = source_clocks.select("zone_name").union(collector_clocks.select("zone_name")).where("zone_name is not null").distinct()

    def run(b: pa.RecordBatch):
        t = [zone_table(z) for z in b["zone_name"].to_pylist()]
        year = lambda x, k: int(x.at[k].astype("datetime64[s]").astype("datetime64[Y]").astype(int)) + 1970 if x and len(x.at) else None
        return {
            "zone_name": b["zone_name"], "tz_version": [x and x.version for x in t], "n_transitions": [x and len(x.at) for x in t],
            "first_year": [year(x, 0) for x in t], "last_year": [year(x, -1) for x in t],
        }

    return arrow_map(names, run, "zone_name string, tz_version string, n_transitions long, first_year int, last_year int")
