import os
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import boilerplate, bpe, langid, leakage, lookalike, mojibake, queries, sitelines, truncation

DATA = Path(os.environ.get("TIDEMARK_DATA", "/root/testdata/sf0.001"))
A = "id string, url string, title string, content string, source_uri string, language string, collection_method string, k long, chunk string, h long, t string, sign string"


def articles(spark, rows):
    """Rows (id, title, content, source, language, method) with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, "http://www.A.com:80/x", t, c, s, g, m, 1, "c", 2, "t", "s") for i, t, c, s, g, m in rows], A)


@pytest.fixture(scope="module")
def clocks(spark):
    return spark.createDataFrame([("page", "UTC", True), ("feed", "UTC", False)], "collection_method string, zone_name string, is_page boolean")


@pytest.fixture(scope="module")
def samples(spark):
    rows = [
        (1, "eng", "The river authority measured the water and the children waited for the new clinic near the old railway line."),
        (2, "spa", "La autoridad del río midió el agua y los niños esperaron la nueva clínica cerca de la vieja línea del tren."),
        (3, "rus", "Речное ведомство измерило воду, и дети ждали новую клинику рядом со старой железной дорогой."),
    ]
    return spark.createDataFrame(rows, "sample_id long, lang string, text string")


EDGES = [("n", None, None, None, None, None), ("e", "", "", "s", "", "page"), ("b", " ", " \n ", "s", "und", "page")]


def test_edges_have_no_cases(spark, clocks, samples):
    a = articles(spark, EDGES + EDGES)
    for df in (a, a.limit(0)):
        assert truncation.p1_found(df).count() == 0
        assert boilerplate.p3_found(df, clocks, samples).count() == 0
        assert langid.p5_found(df, samples).count() == 0
        assert langid.p5_found(df, samples.limit(0)).count() == 0
        assert sitelines.p6_found(df).count() == 0
        assert lookalike.p7_found(df).count() == 0
        assert bpe.p4_budget(df).where("n_tokens > 10").count() == 0
    d = spark.createDataFrame([(1, None), (2, ""), (3, " ")], "doc_id long, text string")
    for df in (d, d.limit(0)):
        assert mojibake.p10_found(df).count() == 0
        assert leakage.p9_found(df, spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0
        assert leakage.p9_found(df, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert {r.doc_id: r.ids for r in bpe.p8_ids(d).collect()} == {1: [], 2: [], 3: [220]}


def test_very_long_texts(spark, clocks, samples):
    """Half a megabyte of lines, one line without an end, and a run of letters without a blank."""
    line = "The river authority measured the water and the children waited for the new clinic.\n"
    texts = [line * 6000, "The river authority measured " * 15_000, "a" * 20_000, "我们测量了水" * 20_000, "é" * 50_000, "\n" * 100_000 + "x"]
    rows = [(f"l{i}", "T" * 3000, t, "s", None, "page") for i, t in enumerate(texts)]
    a = articles(spark, rows)
    assert {r.id for r in truncation.p1_found(a).collect()} <= {f"l{i}" for i in range(len(texts))}
    assert boilerplate.p3_found(a, clocks, samples).count() >= 0 and boilerplate.main_body(a, clocks, samples).count() == len(texts)
    assert sum(r.n_tokens for r in bpe.p4_tokens(a).collect()) > 100_000
    assert langid.p5_found(a, samples).where("line_no = 0").count() >= 4 and langid.p5_segments(a, samples).count() > 6000
    assert sitelines.p6_found(a).count() == 0 and lookalike.p7_found(a).count() == 0
    d = a.selectExpr("cast(substr(id, 2) as bigint) as doc_id", "content as text")
    ids = {r.doc_id: len(r.ids) for r in bpe.p8_ids(d).collect()}
    assert ids[0] == 16 * 6000 and ids[2] > 100
    item = spark.createDataFrame([(1, (line * 2).replace("\n", " ")), (2, "other words " * 400)], "item_id long, text string")
    assert {r.doc_id for r in leakage.p9_found(d, item).where("item_id = 1").collect()} == {0}
    assert {r.doc_id for r in mojibake.p10_found(d).collect()} <= {4} and mojibake.p10_restored(d).count() == len(texts)  # a row of accented letters may count as garbled


def test_truncation(spark):
    story = "The water board described the damage. " + "Volunteers are counting the wells in the lowlands again. " * 8
    rows = [
        ("full", "T", story.strip(), "s", "eng", "feed"),
        ("cut", "T", story[:203].rstrip(), "s", "eng", "feed"),
        ("mark", "T", "A sentence that stops […]", "s", "eng", "feed"),
        ("count", "T", "A sentence that st [+908 chars]", "s", "eng", "feed"),
        ("half", "T", "A sentence. Another drou�", "s", "eng", "feed"),
        ("tag", "T", "A sentence. Another one<a hre", "s", "eng", "feed"),
        ("list", "T", "A sentence.\nShare this", "s", "eng", "feed"),
        *[(f"w{i}", "T", f"Story {i} is whole.\nShare this\nThe end of it.", "s", "eng", "feed") for i in range(3)],
    ]
    got = {r.id for r in truncation.p1_found(articles(spark, rows + rows)).collect()}
    assert got == {"cut", "mark", "count", "half", "tag"}


def test_longer_copies(spark):
    """Pairs of a text that breaks off and a longer copy of the sentence, at few and many partitions, exact copies included."""
    rows = []
    for i in range(300):
        w = "".join(chr(97 + int(d)) for d in f"{i:03d}")
        a = f"the {w} harbour report was read aloud to the {w} council, which waited until the"
        rows += [(f"s{i}", None, f"A {w} lead. {a}", "s", "eng", "rss"), (f"l{i}", None, f"Another start of {w}. {a} water fell again. More.", "t", "eng", "feed")]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("3", "60"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = {r.id for r in truncation.longer_copies(articles(spark, rows + rows).repartition(int(n))).collect()}
            assert got == {f"s{i}" for i in range(300)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert {(r.evidence, r.n) for r in truncation.p1_evidence(articles(spark, rows)).collect()} == {("longer copy", 300)}


def test_longer_copy_of_a_hot_text(spark):
    """A chain of prefixes; a text that most rows hold; a complete sentence with a longer copy is a summary, not a cut."""
    a = "The harbour report was read aloud to the council in the evening session"
    texts = [a + "".join(f"; part {k} of it" for k in range(i)) for i in range(8)]
    rows = [(f"t{i}", None, t, "s", "eng", "feed") for i, t in enumerate(texts)] + [(f"h{i}", None, texts[0], "s", "eng", "rss") for i in range(300)]
    rows += [("summary", None, "The board met.", "s", "eng", "feed"), ("story", None, "The board met. It spoke of the wells.", "s", "eng", "feed"), ("tiny", None, "The boa", "s", "eng", "feed")]
    got = {r.id for r in truncation.longer_copies(articles(spark, rows)).collect()}
    assert got == {f"t{i}" for i in range(7)} | {f"h{i}" for i in range(300)}


def test_prefixes_like_brute_force():
    rng = np.random.default_rng(5)
    values = sorted({"ab"[rng.integers(2)] * 5 + "".join(rng.choice(list("abé"), rng.integers(0, 60))) for _ in range(400)})
    _, prefix, _, data, at = truncation.prefixes(values)
    rows = {}
    for k, a, b in zip(prefix, at, at[1:]):
        rows.setdefault(k, set()).add(bytes(data[a:b]))
    line, asked, _, data, at = truncation.prefixes(values, True)
    long = [v for v in values if len(v.encode()) >= truncation.FIRST]
    assert line.tolist() != [] and sorted(line.tolist()) == list(range(len(long)))
    for n, k, a, b in zip(line, asked, at, at[1:]):
        mine = bytes(data[a:b])
        assert any(r != mine and r.startswith(mine) for r in rows[k]) == any(x != long[n] and x.startswith(long[n]) for x in values)
    assert [len(x) for x in truncation.prefixes([])] == [0, 0, 0, 0, 1] and len(truncation.prefixes(["", "short"])[0]) == 0


def test_lines_known_as_whole(spark):
    """A line is complete only if it stands inside two ids, copies of a row counting once, and not seldom for each end."""
    end = "A sentence of its own.\nA line without an end"
    rows = [("a", None, end, "s", "eng", "feed"), ("b", None, "A line without an end\nText.", "s", "eng", "feed")]
    assert {r.id for r in truncation.p1_found(articles(spark, rows * 3)).collect()} == {"a"}
    assert truncation.p1_found(articles(spark, rows + [("c", "A line without an end", "Text.", "s", "eng", "feed")])).count() == 0
    sources = {r.source_uri: (r.n_ids, r.n_cut) for r in truncation.p1_sources(articles(spark, rows * 2 + [("z", None, "Cut in the mid", None, "eng", "feed")])).collect()}
    assert sources == {"s": (2, 1), None: (1, 1)}


def test_boilerplate(spark, clocks, samples):
    """Prompts and notices are learned from the other pages, none of them is known beforehand."""
    body = "The water board described the damage to the wall, and the river authority asked for help with new wells."
    foot = "Enjoying this article? Become a member today for less than a coffee a week."
    page = f"Home | World | Opinion | Video\nA headline of our own story here\nBy the climate desk | 01.01.2021\n{body}\n{body}\n{foot}\n{body} {body}\nMost read\n© 2021 Paper. All rights reserved."
    others = [(f"o{i}", f"Headline {w} here", f"The {w} board met and spoke of {w} wells in the valley.\n{foot}\nMost read\nBy the climate desk | 0{i}.01.2021", "s", "eng", "page") for i, w in enumerate(("north", "south", "east", "west"), 1)]
    a = articles(spark, [("p", "A headline of our own story here", page, "s", "eng", "page"), ("f", "x", body + "\nThe board asked for help with the wells.", "s", "eng", "feed"), *others])
    assert sorted((r.id, r.line_no) for r in boilerplate.p3_found(a, clocks, samples).where("id = 'p'").collect()) == [("p", n) for n in (1, 3, 6, 8, 9)]
    bodies = {r.id: r.body for r in boilerplate.main_body(a, clocks, samples).collect()}
    assert bodies["o1"] == "The north board met and spoke of north wells in the valley." and "f" not in bodies


def test_best_region_is_the_greatest_sum():
    rng = np.random.default_rng(0)
    for _ in range(200):
        x = rng.integers(-5, 6, 12).tolist()
        a, b = boilerplate.best_region(x)
        assert sum(x[a:b]) == max([0] + [sum(x[i:j]) for i in range(12) for j in range(i + 1, 13)])


def test_languages(spark, samples):
    e, s = "The river authority measured the water near the clinic.", "La autoridad del río midió el agua de la clínica."
    a = articles(spark, [("ok", None, e, "s", "EN", "feed"), ("none", None, e, "s", None, "feed"), ("wrong", None, s, "s", "eng", "feed"), ("mix", None, e + "\n" + e + "\n\n" + s, "s", "en-GB", "feed")])
    got = {(r.id, r.line_no, r.lang) for r in langid.p5_found(a, samples).collect()}
    assert got == {("none", 0, "eng"), ("wrong", 0, "spa"), ("mix", 4, "spa")}
    two = articles(spark, [("two", None, e + " " + e + " " + s + "\n" + e, "s", "eng", "feed"), ("blank", None, " \n ", "s", "eng", "feed"), ("none", None, None, "s", "eng", "feed")])
    got = sorted((r.line_no, r.start, r.length, r.lang) for r in langid.p5_segments(two.union(two), samples).collect())
    assert got == [(1, 1, 2 * len(e) + 2, "eng"), (1, 2 * len(e) + 3, len(s), "spa"), (2, 1, len(e), "eng")]
    assert langid.p5_segments(two, samples.limit(0)).count() == 0
    conf = [r.confidence for r in langid.p5_languages(a, samples).collect()]
    assert all(0 < c <= 1 for c in conf)


def test_code_lengths_like_a_plain_tree():
    """The tabulated model against a direct walk down the orders."""
    from collections import Counter, defaultdict

    pairs = [("a", "abracadabra abba"), ("b", "bobo coco bobby")]
    m = langid.Model(pairs, order=3)
    trees = {}
    for lang, text in pairs:
        t = defaultdict(Counter)
        s = b"\n" + langid.prepared(text) + b"\n"
        for i in range(1, len(s)):
            for k in range(min(3, i) + 1):
                t[s[i - k : i]][s[i]] += 1
        trees[lang] = t
    line = b"abba coco zz"
    bits, _ = m.line_bits(line)
    s = b"\n" + line + b"\n"
    for j, lang in enumerate(m.langs):
        total = 0.0
        for i in range(1, len(s)):
            for k in range(min(3, i), -1, -1):
                c = trees[lang].get(s[i - k : i])
                if not c:
                    continue
                n, d = sum(c.values()), len(c)
                if s[i] in c:
                    total += -np.log2(c[s[i]] / (n + d))
                    break
                total += -np.log2(d / (n + d))
            else:
                total += 8
        assert abs(total - bits[0, j]) < 1e-2


def test_site_lines(spark):
    rows = [(f"d{i}", None, f"Own text number {'abcdefghijkl'[i]} here\nShare  this story {i}\n\nshare THIS story", "s", "eng", "feed") for i in range(4)]
    rows += [("x", None, "Share this story", "other", "eng", "feed"), ("y", None, "Share this story", None, "eng", "feed")]
    got = sorted((r.id, r.line_no) for r in sitelines.p6_found(articles(spark, rows + rows)).collect())
    assert got == [(f"d{i}", n) for i in range(4) for n in (2, 4)]
    clean = {r.id: r.content for r in sitelines.cleaned(articles(spark, rows), sitelines.p6_found(articles(spark, rows))).collect()}
    assert clean["d0"] == "Own text number a here\n" and clean["x"] == "Share this story"


def test_share_is_exact(spark):
    rows = [(f"d{i:03d}", None, "Same line" if i < 7 else f"Line {'x' * (i % 50)} {chr(97 + i % 26)}{chr(97 + i // 26)}", "s", "eng", "feed") for i in range(140)]
    assert sitelines.p6_found(articles(spark, rows)).count() == 7  # 7 of 140 is 5 %


def test_chunks_dont_depend_on_their_place():
    line = "a fairly long line that is cut into several pieces by its content, wherever it may stand in a document " * 3
    alone = sitelines.chunk_hashes([line])[0].tolist()
    chunks, at = sitelines.chunk_hashes(["before", "", line, "after"])
    assert chunks[at == 2].tolist() == alone and len(alone) > 1


@pytest.mark.parametrize(
    "text, case",
    [("plain", False), ("café", True), ("café", False), ("ａ", True), ("ﬁne", True), ("a​b", True), ("a b", True), ("crоp", True), ("станция", False), ("cтанция", True),
     ("“x” – y… • z", False), ("night‑time", True), ("ցood", True), ("，。：", False), ("CO₂ m²", False), ("�", False), ("tab\tline\r\n", False), ("Москва is far", False)],
)
def test_lookalikes(text, case):
    assert (lookalike.canonical(text) != text) is case
    assert lookalike.canonical(lookalike.canonical(text)) == lookalike.canonical(text)


def test_consistent_fields(spark):
    rows = [("a", "STRAẞE ＡＢ", "plain Text\n", "s", "eng", "feed"), ("b", None, "", "s", "eng", "feed"), ("c", "night‑time", "Cafe\u0301", "s", "eng", "feed"), ("d", "Straße", "İ", "s", "eng", "feed")]
    df = articles(spark, rows + rows)
    got = {r.id: (r.title, r.title_folded, r.content, r.content_folded) for r in lookalike.consistent(df, ["title", "content"], "_folded").collect()}
    assert got == {"a": ("STRAẞE AB", "strasse ab", "plain Text\n", "plain text\n"), "b": (None, None, "", ""), "c": ("night-time", "night-time", "Café", "café"), "d": ("Straße", "strasse", "İ", "i̇")}
    assert sorted((r.id, r.field_name) for r in lookalike.p7_found(df).collect()) == [("a", "title"), ("c", "content"), ("c", "title")]
    assert lookalike.consistent(df.limit(0), ["title"]).count() == 0


def test_tokens_like_the_public_tokenizer():
    import public_tokenizers as P
    import tiktoken

    v = bpe.vocabulary(bpe.vocabulary_path())
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    texts = ["", None, " ", "Hello world's  end\n\n x", "<|endoftext|>", "在远离首都的地方，柳河镇", "a" * 700, "  x y ", "🔥👩🏽‍🌾", " 1234567 ", "two  blanks and\n lines with words " * 40, "a\u00a0b c\u3000 d", "x " * 70, "tab\t x\r\n y"]
    e = bpe.Encoder(v)
    for _ in range(2):
        ids, n = e.batch(texts)
        at = np.concatenate([[0], np.cumsum(n)])
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == (enc.encode_ordinary(t) if t else [])
        assert len(e.index) == e.start.n == e.size.n and all(len(k) <= bpe.LONGEST for k in (*e.index, *e.pieces))
    assert bpe._counted(texts, bpe._Known(v)) == [len(enc.encode_ordinary(t)) if t else 0 for t in texts]


def test_long_pieces_like_one_merge_after_another():
    rng = np.random.default_rng(8)
    v = bpe.vocabulary(bpe.vocabulary_path())
    pieces = [b"a" * 301, b"ab" * 400, "我们测量了水".encode() * 60, "é".encode() * 333, bytes(rng.integers(0, 256, 700).astype(np.uint8)), b"the" * 150 + b"er" * 90, b"-=" * 400]
    pieces += [bytes(rng.choice(list(b"etaoin shr"), 600).astype(np.uint8)) for _ in range(20)]
    for p in pieces:
        size = 1 << (len(p) - 1).bit_length()
        assert bpe._encode_long([p], size, v)[0].tolist() == bpe._encode_class([p], size, v)[0].tolist()
    got = bpe._encode_long(pieces, 2048, v)
    assert [x.tolist() for x in got] == [bpe._encode_class([p], 2048, v)[0].tolist() for p in pieces]
    assert [len(x) for x in got] == [bpe.count_symbols(p, v) for p in pieces]

    class Odd(bpe.Vocabulary):  # a longer string that ranks below its part: merging all at once would be wrong
        def __init__(self):
            self.pairs = {(1, 2): 10, (0, 10): 5, (5, 1): 6, (6, 2): 7}

        def rank_of(self, a, b):
            return np.array([self.pairs.get((int(x), int(y)), bpe.INF) for x, y in zip(a, b)])

    o = Odd()
    o.byte = np.arange(256)
    for raw in (bytes([0, 1, 2, 1, 2, 1, 2]), bytes([1, 2, 0, 1, 2, 1, 2, 0, 1, 2] * 3)):
        assert bpe._encode_long([raw], 32, o)[0].tolist() == bpe._encode_class([raw], 32, o)[0].tolist()


def test_budget_counts_copies_once(spark):
    rows = [("a", None, "one two", "s", "eng", "feed"), ("a", None, "two one", "s", "eng", "feed"), ("b", None, None, "s", None, "feed"), ("b", None, "", "s", None, "feed")]
    got = {(r.slice, r.value): (r.n_articles, r.n_tokens) for r in bpe.p4_budget(articles(spark, rows * 3)).collect()}
    assert got == {("source_uri", "s"): (4, 4), ("language", "eng"): (2, 4), ("language", None): (2, 0), ("domain", "a.com"): (4, 4)}
    assert sorted((r.id, r.n_tokens) for r in bpe.p4_tokens(articles(spark, rows * 2)).collect()) == [("a", 2), ("a", 2), ("b", 0), ("b", 0)]


def test_leaks(spark):
    item = " ".join(f"word{i}" for i in range(40))
    filler = " ".join(f"other{i}" for i in range(60))
    docs = [(1, f"{filler} {' '.join(item.split()[5:18])} {filler}"), (2, f"{filler} {' '.join(item.split()[5:17])} {filler}"), (3, item.upper().replace(" ", ", ")), (4, filler)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(7, item), (8, "too short"), (9, None)], "item_id long, text string")
    assert sorted(tuple(r) for r in leakage.p9_found(d, i).collect()) == [(1, 7), (3, 7)]
    assert {r.run_words for r in leakage.p9_report(d, i).where("doc_id = 2").collect()} == {12}


def test_any_number_of_items(spark):
    """25,000 items in groups and blocks; those of the last ones are found as well."""
    text = lambda i: " ".join(f"w{i}x{k}" if k % 3 == 0 else f"c{(i * 7 + k * 13) % 900}" for k in range(16))
    n = 25_000
    d = spark.createDataFrame([(i, f"before {text(i)} after") for i in (0, 11_000, n - 1)] + [(-1, "x" * 200 + " \x00 " + text(5))], "doc_id long, text string")
    items = spark.range(n).select(F.col("id").alias("item_id"), F.udf(text, "string")("id").alias("text"))
    assert sorted(tuple(r) for r in leakage.p9_found(d, items).collect()) == [(-1, 5), (0, 0), (11_000, 11_000), (n - 1, n - 1)]


def test_checks_like_plain_tables():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = rng.integers(0, 6, 20).tolist(), rng.integers(0, 5, 15).tolist()
        run, lcs = np.zeros((21, 16), int), np.zeros((21, 16), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                run[i + 1, j + 1] = run[i, j] + 1 if x == y else 0
                lcs[i + 1, j + 1] = lcs[i, j] + 1 if x == y else max(lcs[i, j + 1], lcs[i + 1, j])
        places = leakage._places(b)
        assert leakage.longest_run(a, places) == run.max() and leakage.common_subsequence(a, places, len(b)) == lcs[-1, -1]


@pytest.mark.parametrize(
    "good, by, written",
    [("déclaré", "cp1252", "utf-8"), ("déclaré", "cp437", "utf-8"), ("première", "mac_roman", "utf-8"), ("Областное управление", "cp1251", "utf-8"), ("Областное", "latin-1", "cp1251"), ("farmers’", "cp1252", "utf-8"),
     ("PflegekrÃ¤ften", "cp1252", "utf-8"), ("déclaré", "cp1251", "cp1252"), ("días", "cp850", "cp1252"), ("“Nobody", "mac_roman", "cp1252"), ("–", "cp437", "cp1252"), ("für", "cp850", "cp1252"), ("farmers’", "mac_roman", "cp1252"),
     ("erklärte", "cp850", "cp1252"), ("exaustão", "mac_roman", "cp1252"), ("L’ufficio", "cp850", "cp1252"), ("Verzögerung", "cp850", "cp1252")],
)
def test_mojibake(good, by, written):
    bad = good.encode(written).decode(by, "replace")
    assert mojibake.garbled("some words " + bad + " and more")
    assert mojibake.restored_text(bad) in (good, "Pflegekräften")


def test_long_tokens_come_out_like_short_ones():
    for good, by in (("déclarée", "cp1252"), ("très", "mac_roman"), ("für ", "cp437")):
        bad = good.encode().decode(by)
        assert "".join(mojibake._parts(bad * 300)) == bad * 300 and mojibake.restored_text(bad * 300) == good * 300


def test_search_finds_the_cheapest_text():
    """Against every descending path of up to four steps."""
    def all_paths(token):
        best, todo = (mojibake.cost(token) - mojibake.MARGIN, None), [(mojibake.cost(token), token, 0.0, False)]
        for _ in range(4):
            more = []
            for whole, text, paid, read in todo:
                for out, price, reading in mojibake._steps(text, 1e9):
                    c = paid + price + mojibake.cost(out)
                    if c < whole:
                        more.append((c, out, paid + price, read or reading))
                        if (read or reading) and c < best[0]:
                            best = (c, out)
            todo = more
        return best[1]

    for token in ("Ã©t", "ìNo", "dÃ­as", "f³r", "plano", "é", "ÃÂ©", "ñ", "Îáë", "&Atilde;&copy;"):
        assert mojibake.restore(token) == all_paths(token), token


@pytest.mark.parametrize("text", ["NÃO À SECA", "été", "tôt", "L’étude “x” – y", "健康诊所报告了登革热", "Областное управление", "स्वास्थ्य केंद्र", "ศูนย์สุขภาพ", "보건소", "CO₂ 25 °C ½ m²", "👩🏽‍🌾 🌍", "AT&amp;T &nbsp; x", "ação coração", "Straße", "« Nous »", "l&#39;étude, d&#39;épuisement", "così virtù São põe você allô", "así, sí", "Malmö Hawaï canoë col·lecció dû crû", "5·10 m²", "x" * 5000 + "é", "健" * 3000])
def test_not_mojibake(text):
    assert not mojibake.garbled(text) and mojibake.restored_text(text) == text


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    cols = sorted(queries.queries()[name](spark, str(DATA)).columns)
    a = queries.queries()[name](spark, str(DATA)).toPandas()[cols].values.tolist()
    assert sorted(map(str, a)) == sorted(map(str, con.execute(queries.oracle_sql()[name]).df()[cols].values.tolist()))
