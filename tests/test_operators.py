import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import labels as L
from tidemark.functions import text as X
from tidemark.operators import inference, keywords, marginal, metrics, posterior, rollup, sampler, sampling
from tidemark.operators import timestamps as T
from tidemark.sources import readers, sinks
from tidemark.streaming import ingest


def utc(value, zone=None, locale=None):
    us, ok = T.normalise([value], [zone], [locale])
    return str(us.astype("datetime64[us]")[0]) if ok[0] else None


@pytest.mark.parametrize(
    "value, zone, locale, want",
    [
        ("2021-01-01T01:00:00.113+01:00", None, None, "2021-01-01T00:00:00.113000"),
        ("2021-01-01T00:30:00.911192002+01:00", None, None, "2020-12-31T23:30:00.911192"),
        ("Thu, 31 Dec 2020 18:30:00 -0500", None, None, "2020-12-31T23:30:00.000000"),
        ("01/12/2021 04:18 PM", "America/New_York", "en-US", "2021-01-12T21:18:00.000000"),
        ("01/12/2021 16:18", "Europe/London", "en-GB", "2021-12-01T16:18:00.000000"),
        ("28 Feb 2021, 17:12 IST", "Asia/Kolkata", "en-IN", "2021-02-28T11:42:00.000000"),
        ("2021-03-01 08:00 CST", "Asia/Shanghai", "zh-CN", "2021-03-01T00:00:00.000000"),
        ("2021年2月23日 05:25", "Asia/Shanghai", "zh-CN", "2021-02-22T21:25:00.000000"),
        ("16 de fevereiro de 2021 às 01:17", "America/Sao_Paulo", "pt-BR", "2021-02-16T04:17:00.000000"),
        ("December 31, 2020 at 6:30 p.m.", "America/New_York", "en-US", "2020-12-31T23:30:00.000000"),
        ("27.03.2021, 13:20 Uhr", "Europe/Berlin", "de-DE", "2021-03-27T12:20:00.000000"),
        ("26/01/2021 à 03h59", "Europe/Paris", "fr-FR", "2021-01-26T02:59:00.000000"),
        ("1609457400759", None, None, "2020-12-31T23:30:00.759000"),
        ("1609457989.941", None, None, "2020-12-31T23:39:49.941000"),
        ("2024-02-29 00:00:00 GMT", None, None, "2024-02-29T00:00:00.000000"),
        ("2023-02-29 00:00:00 GMT", None, None, None),
        ("2021-10-31 01:45", "Europe/London", "en-GB", None),  # twice
        ("2021-03-28T01:01:24", "Europe/London", "en-GB", None),  # never
        ("2021-01-01T00:00:00", None, None, None),
        ("07/05/2021 06:50", "Europe/London", None, None),
        ("2021-01-05", "Europe/Rome", "it-IT", None),
        ("yesterday", "Europe/Rome", "it-IT", None),
        ("", None, None, None),
        (None, None, None, None),
        ("x" * 10_000, None, None, None),
        ("1965-07-01 12:00", "America/New_York", "en-US", "1965-07-01T16:00:00.000000"),
        ("2120-07-01 12:00", "America/New_York", "en-US", "2120-07-01T16:00:00.000000"),
        ("1890-01-01 00:00", "Europe/Paris", "fr-FR", "1889-12-31T23:50:39.000000"),
        ("9999-01-15 00:00", "Europe/Berlin", "de-DE", "9999-01-14T23:00:00.000000"),
        ("2021-06-01" + " " * 500 + "10:00" + "\t\n" * 40 + "UTC", None, None, "2021-06-01T10:00:00.000000"),
        ("2021-06-01T10:00:00Z", "No/Such_Zone", None, "2021-06-01T10:00:00.000000"),
        ("2021-06-01T10:00", "No/Such_Zone", None, None),
        ("2021-06-01T10:00", "../../etc/passwd", None, None),
        ("٢٠٢١-٠٦-٠١T10:00:00Z", None, None, None),
    ],
)
def test_instants(value, zone, locale, want):
    assert utc(value, zone, locale) == want


def test_found_instants(spark):
    a = spark.createDataFrame(
        [("a", "s", "m", "2021-01-01T00:00:00Z", "2021-01-01T00:00:00+01:00", 1), ("a", "s", "m", "2021-01-01T00:00:00Z", "2021-01-01T00:00:00+01:00", 1), ("b", None, None, None, None, 2)],
        "id string, source_uri string, collection_method string, published_date string, extracted_at string, zone long",
    )
    s = spark.createDataFrame([], "source_uri string, zone_name string, locale string")
    c = spark.createDataFrame([("m", "UTC", True)], "collection_method string, zone_name string, is_page boolean")
    assert [tuple(r) for r in T.p2_found(a, s, c).collect()] == [("a", "extracted_at", "2020-12-31T23:00:00.000000Z")]
    assert T.p2_found(a.limit(0), s, c).count() == 0


def test_phrases_like_python(spark):
    terms = ["aa", "net-zero", "über", "-a", "a-", "sea level"]
    texts = ["aa aa aa", "aaaa", "net-zero netzero NET-ZERO", "Über über_ über", "x -a b", "a- b", "sea level sea  level", "", "জলবায়ু"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for term in terms:
        got = [r[0] for r in df.select(X.phrase_count(F.lower("t"), term)).collect()]
        assert got == [len(re.findall(r"\b" + re.escape(term) + r"\b", t.lower())) for t in texts], term


def test_substring_and_length(spark):
    df = spark.createDataFrame([("干旱和干旱", "zho"), ("one  two\x1cthree", "eng"), (None, "eng"), ("", "eng")], "t string, l string")
    assert [r[0] for r in df.select(X.substring_count(F.col("t"), "干旱")).collect()][0] == 2
    assert [r[0] for r in df.select(X.doc_length(F.col("t"), F.col("l"))).collect()] == [5, 3, None, 0]


def test_allocation_like_loop(spark):
    rng = random.Random(1)
    for _ in range(5):
        sizes = {f"s{i}": rng.randint(1, 60) for i in range(8)}
        target, floor = rng.randint(10, 120), 3
        total, rest = sum(sizes.values()), max(0, target - 8 * floor)
        want = {k: min(n, floor + round(rest * n / total)) for k, n in sizes.items()}
        gap = target - sum(want.values())
        for k, n in sorted(sizes.items(), key=lambda kv: (-kv[1], kv[0])):
            if gap <= 0:
                break
            add = min(n - want[k], gap)
            want[k] += add
            gap -= add
        df = spark.createDataFrame(list(sizes.items()), "k string, size long")
        assert {r.k: r.n_sample for r in sampling.allocation(df, ["k"], "size", target, floor).collect()} == want


def test_chunks(spark):
    k = spark.createDataFrame([("t", "l", i, x) for i, x in enumerate(["a b", "c", "d e", "f g h i j k", "l"])], "topic string, lang string, pos int, term string")
    assert [(r.pos, r.chunk) for r in keywords.chunks(k, 4).orderBy("pos").collect()] == [(0, 1), (1, 1), (2, 2), (3, 3), (4, 4)]
    assert keywords.chunks(k.limit(0), 4).count() == 0
    assert json.loads(keywords.to_nested(k).first().json)["t"]["l"][1] == "c"


def test_null_keys_form_no_group(spark):
    df = spark.createDataFrame([("a", True), (None, True), ("a", None)], "k string, y boolean")
    assert [tuple(r) for r in rollup.cell_rollup(df, ["k"], F.col("y"), {}).collect()] == [("a", 2, 1)]
    assert rollup.stats_from_rows(df, ["k"], F.col("y")).first().n == 1
    with pytest.raises(ValueError):
        rollup.require_resolved(df.where("k = 'a'"), df.where("false"), "k")


def test_labels(spark):
    df = spark.createDataFrame([("<think>health:\n label: true</think>health:\n  label: FALSE",), ("<think>open health:\n label: true",), ("none",), (None,)], "r string")
    assert [r[0] for r in df.select(L.parsed_label(F.col("r"), "health")).collect()] == [False, True, None, None]
    assert spark.range(1).select(L.json_array(F.lit('x ["a", "b"] y'))).first()[0] == ["a", "b"]


def test_reports_of_nothing(spark):
    df = spark.createDataFrame([], "p boolean, t boolean")
    assert metrics.exact_match(df, {"x": ("p", "t")}).first().rate == 0.0
    assert metrics.multilabel_report(df, {"x": ("p", "t")}).count() >= 1


def test_diagnostics():
    x = np.random.default_rng(0).normal(size=(4, 500))
    d = posterior.diagnose(x)
    assert abs(d["r_hat"] - 1) < 0.02 and d["ess_bulk"] > 1200
    assert posterior.diagnose(x + np.arange(4)[:, None] * 3)["r_hat"] > 1.5


def test_zones_like_the_tz_library():
    import datetime as dt
    import zoneinfo

    rng, start = random.Random(3), dt.datetime(1970, 1, 1)
    for name in ("Europe/Dublin", "America/New_York", "Africa/Casablanca", "Pacific/Apia", "Asia/Kolkata", "UTC", "America/Sao_Paulo"):
        zone, table = zoneinfo.ZoneInfo(name), T.zone_table(name)
        walls = [dt.datetime(rng.choice([rng.randint(1, 9999), rng.randint(1880, 2100)]), rng.randint(1, 12), rng.randint(1, 28), rng.randint(0, 23), rng.randint(0, 59)) for _ in range(200)]
        utc, one = table.to_utc(np.array([int((x - start).total_seconds()) for x in walls]))
        for x, u, k in zip(walls, utc, one):
            a, b = (x.replace(tzinfo=zone, fold=f).utcoffset() for f in (0, 1))
            assert bool(k) == (a == b) and (a != b or u == int((x - start - a).total_seconds()))


def test_zone_report(spark):
    s = spark.createDataFrame([("a", "Europe/Paris", "fr-FR"), ("b", "No/Zone", None), ("c", None, None)], "source_uri string, zone_name string, locale string")
    c = spark.createDataFrame([("m", "UTC", True)], "collection_method string, zone_name string, is_page boolean")
    got = {r.zone_name: r for r in T.p2_zones(s, c).collect()}
    assert set(got) == {"Europe/Paris", "No/Zone", "UTC"} and got["No/Zone"].tz_version is None and got["Europe/Paris"].last_year > 2500 and got["UTC"].n_transitions == 0


@pytest.mark.parametrize("time, options", [(False, {}), (False, {"independent": True}), (True, {}), (True, {"global_time": False}), (True, {"group_time": False, "independent": True})])
def test_gradient(time, options):
    m = sampler.Model(["a", "b", "c", "a"], ["x", "x", "y", "x"], [3, 5, 2, 4], [10, 20, 9, 11], ["1", "2", "2", "2"] if time else None, **options)
    q = np.random.default_rng(1).normal(0, 0.3, m.size)
    lp, g = m.log_density(q)
    for i in range(len(q)):
        e = np.zeros(len(q))
        e[i] = 1e-6
        assert abs((m.log_density(q + e)[0] - m.log_density(q - e)[0]) / 2e-6 - g[i]) < 1e-4
    params = {p for p, _, _ in sampler.derived(m, q)}
    assert ("prevalence_group_time" in params) is time and ("prevalence_time" in params) is (time and options.get("global_time", True))


def test_gradient_of_centred_countries():
    rng = np.random.default_rng(0)
    c = np.repeat([f"c{i}" for i in range(6)], 8)
    n, p = rng.integers(50, 90, len(c)), np.where(c < "c3", np.repeat(np.linspace(0.1, 0.8, 6), 8), 0.3)
    for independent in (False, True):
        m = sampler.Model(c, np.where(c < "c3", "x", "y"), rng.binomial(n, p), n, independent=independent)
        assert m.centred.tolist() == [True] * 3 + [False] * 3
        q = rng.normal(0, 0.3, m.size)
        g = m.log_density(q)[1]
        assert max(abs((m.log_density(q + e)[0] - m.log_density(q - e)[0]) / 2e-6 - x) for x, e in zip(g, np.eye(m.size) * 1e-6)) < 1e-4


@pytest.mark.parametrize("visits", [1, 10**9])
def test_marginal_like_a_dense_sum(monkeypatch, visits):
    """Patches (fitted at the first visit) and quadrature against 200,001 points."""
    monkeypatch.setattr(marginal, "VISITS", visits)
    z = np.linspace(-12, 12, 200_001)
    rows = [(0, 0, 300, 1), (0, 150, 300, 2), (0, 0, 0, 1), (1, 1, 1, 5), (1, 0, 4, 1), (2, 40, 5000, 1)]
    m = marginal.Marginal(*(np.array(x) for x in zip(*[(c, float(k), float(n), float(w)) for c, k, n, w in rows])), 3)
    for e, s in ((np.array([-0.4, 0.7, -5.0]), np.array([0.02, 1.5, 0.4])), (np.array([0.3, -2.0, -4.0]), np.array([1.2, 1e-6, 0.1]))):
        want = np.zeros((3, 3))
        for c, k, n, w in rows:
            eta = e[c] + s[c] * z
            h = k * eta - n * np.logaddexp(0, eta) - z * z / 2
            d, r = np.exp(h - h.max()), k - n / (1 + np.exp(-eta))
            want[:, c] += w * np.array([h.max() + np.log(d.sum() * (z[1] - z[0]) / np.sqrt(2 * np.pi)), (d @ r) / d.sum(), (d @ (r * z)) / d.sum()])
        assert np.allclose(m(e, s), want, rtol=1e-5, atol=1e-5)
        assert m.fitted.all() == (visits == 1)


def test_sampler_costs_by_countries_not_sources(spark):
    """A chain has no parameter per source, holds equal rows once, and the draws are made once for all who read them."""
    two = sampler.Model(["a", "b"], ["x", "x"], [3, 5], [10, 20])
    many = sampler.Model(["a", "b"] * 3000, ["x"] * 6000, [3, 5] * 3000, [10, 20] * 3000)
    assert many.size == two.size
    pooled = sampler.Model(["a", "b"], ["x", "x"], [3, 5], [10, 20], weight=[3000, 3000])
    q = np.random.default_rng(1).normal(0, 0.3, two.size)
    assert np.allclose(many.log_density(q)[0], pooled.log_density(q)[0]) and np.allclose(many.log_density(q)[1], pooled.log_density(q)[1])
    stats = spark.createDataFrame([("a", "x", 3, 10)] * 50 + [("b", "x", 5, 20)] * 50, "country string, group string, k long, n long")
    d = sampler.hierarchical_prevalence(stats, chains=2, draws=20, tune=20, max_rows=2)
    assert d.count() == 2 * 20 * 5 and "MapInPandas" not in d._jdf.queryExecution().toString()


def test_sampler_finds_the_truth(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g, p in (("high", 0.3), ("low", 0.1)):
        rows += [(f"{g}{c}", g, int(rng.binomial(400, p)), 400) for c in range(12)]
    d = sampler.hierarchical_prevalence(spark.createDataFrame(rows, "country string, group string, k long, n long"), chains=2, draws=150, tune=300).cache()
    med = {r.level: r.median for r in posterior.summary(d.where("param = 'prevalence_group'"), ["level"]).collect()}
    assert abs(med["high"] - 0.3) < 0.05 and abs(med["low"] - 0.1) < 0.04
    worst = posterior.worst(posterior.diagnostics(d.where("param = 'prevalence_group'"), ["param", "level"]), d).first()
    assert worst.n_divergences < 15 and worst.max_r_hat < 1.1


def test_sampler_samples_a_known_posterior():
    """Without data the draws follow the prior: mu_global is N(-2, 2)."""
    q, bad = sampler.chain(sampler.Model(["a"], ["x"], [0], [0]), 1500, 500, 7)
    assert abs(q[:, 0].mean() + 2) < 0.35 and abs(q[:, 0].std() - 2) < 0.3 and abs(q[:, 2].std() - 1) < 0.12 and bad.mean() < 0.05


def test_time_effects(spark):
    rows = [(f"c{c}", "g", t, int(400 * p), 400) for c in range(6) for t, p in (("2021", 0.1), ("2022", 0.3))]
    stats = spark.createDataFrame(rows, "country string, group string, time_period string, k long, n long")
    d = sampler.hierarchical_prevalence(stats, chains=2, draws=150, tune=250)
    med = {r.level: r.median for r in posterior.summary(d.where("param = 'prevalence_time'"), ["level"]).collect()}
    assert med["2021"] < 0.17 and med["2022"] > 0.2
    with pytest.raises(ValueError, match="at most"):
        sampler.hierarchical_prevalence(stats, max_rows=3)
    with pytest.raises(ValueError, match="columns"):
        sampler.hierarchical_prevalence(stats.drop("k"))
    assert sampler.hierarchical_prevalence(stats.limit(0), chains=1).count() == 0
    assert sampler.prepared(stats.columns) and not sampler.prepared(["source_uri", "n"]) and sampler.run_matrix(spark).count() == 4


def test_quotas_are_largest_remainders(spark):
    rng = random.Random(4)
    for _ in range(4):
        counts = {f"c{i}": rng.choice([1, 1, 2, 3, 17, 60, 111]) for i in range(7)}
        got = {r.k: (r.a, r.b) for r in sampling.quotas(spark.createDataFrame(list(counts.items()), "k string, n long"), "k", "n", [("a", 0.2), ("b", 0.1)]).collect()}
        left = dict(counts)
        for part, share in ((0, 0.2), (1, 0.1)):
            total = sum(left.values())
            want = math.ceil(round(total * share, 9))
            exact = {k: want * n / total for k, n in left.items()}
            take = {k: int(x) for k, x in exact.items()}
            for k in sorted(left, key=lambda k: (-round(exact[k] - int(exact[k]), 9), k))[: want - sum(take.values())]:
                take[k] += 1
            assert {k: v[part] for k, v in got.items()} == take and sum(take.values()) == want
            left = {k: left[k] - take[k] for k in left}


def test_shuffled_ranks(spark):
    df = spark.range(3000).select((F.col("id") % 3 == 0).alias("k"), "id", F.md5(F.col("id").cast("string")).alias("h")).unionByName(spark.createDataFrame([(None, 9999, "0" * 32)], "k boolean, id long, h string"))
    got = sampling.shuffled_rank(df, ["k"], "h", "id").select("k", "h", "__rank").collect()
    for k in (True, False, None):
        mine = sorted((r.h, r["__rank"]) for r in got if r.k is k)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))
    split = {r.split: r.n for r in sampling.exact_split(df, "id", "k", (0.2, 0.1), 1).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert split == {"test": 601, "validation": 240, "train": 2160}
    assert sampling.exact_split(df.limit(0), "id", "k", (0.2, 0.1), 1).count() == 0


def test_united_keywords(spark):
    k = [("t", "eng", 0, "Drought"), ("t", "eng", 1, "dengue"), ("t", "eng", 2, "drought"), ("t", "spa", 0, "sequía"), ("t", "spa", 1, "Dengue"), ("t", "zho", 0, "干旱"), ("t", "spa", 2, None), ("u", "fra", 0, "x")]
    got = keywords.with_english(spark.createDataFrame(k, "topic string, lang string, pos int, term string"))
    lists = {}
    for r in got.orderBy("topic", "lang", "pos").collect():
        lists.setdefault((r.topic, r.lang), []).append(r.term)
    assert lists == {("t", "eng"): ["Drought", "dengue"], ("t", "spa"): ["Drought", "dengue", "sequía"], ("t", "zho"): ["Drought", "dengue", "干旱"], ("u", "fra"): ["x"]}
    df = spark.createDataFrame([("a drought", "spa"), ("旱干旱", "zho"), ("DENGUE病", "zho"), ("sequía", "eng"), ("drought", None)], "t string, l string")
    terms = {lang: ts for (t, lang), ts in lists.items() if t == "t"}
    assert [r[0] for r in df.select(X.keyword_match(F.col("t"), F.col("l"), terms)).collect()] == [True, True, True, False, True]
    assert [r[0] for r in spark.createDataFrame([("French",), ("french",), (None,)], "n string").select(X.language_code(F.col("n"))).collect()] == ["fra", "", ""]


def test_scores_of_nothing(spark):
    terms = {"climate": {"eng": ["sea"]}, "health": {"eng": []}}
    d = spark.createDataFrame([(1, "the sea", "eng"), (2, "", "eng"), (3, "x", "xxx")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.bm25_avg for r in X.bm25(X.hits(d, terms, "doc_id", "text", "lang"), "doc_id", "lang", ["climate", "health"]).collect()}
    assert set(got) == {1, 2} and got[1] > 0 and got[2] == 0.0
    assert X.bm25(X.hits(d.limit(0), terms, "doc_id", "text", "lang"), "doc_id", "lang", ["climate", "health"]).count() == 0


def test_dimension_joins(spark):
    d = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None), (None, 9, "z")], "k string, line int, v string")
    assert {(r.k, r.v) for r in rollup.last_wins(d, "k", ["line"], ["v"]).collect()} == {("a", "y"), ("b", None)}
    f = spark.createDataFrame([("a", 0), ("c", 0), (None, 0)], "k string, line int")
    assert {(r.k, r.v) for r in rollup.left_attributes(f, d.drop("line"), "k").collect()} == {("a", "x"), ("c", None), (None, None)}
    assert {(r.k, r.v) for r in rollup.lookup(f, d.where("v is not null"), "k", "v", "-", "line").collect()} == {("a", "y"), ("c", "-"), (None, "-")}
    assert {(r.k, r.v, r.line) for r in rollup.override(d, "k", "b", {"v": "set", "line": 0}).collect()} == {("a", "x", 1), ("a", "y", 2), ("b", "set", 0), (None, "z", 9)}
    assert rollup.without(rollup.without(d, ["v"]), ["v"]).columns == ["k", "line"]
    assert rollup.where_given(d, {"k": None}, {"k": []}, {"k": ["a"]}).count() == 2 and rollup.where_given(d, {"k": "a"}, {"line": [2]}).count() == 1
    assert rollup.distinct_counts(d, ["k", "line"]).first().asDict() == {"n_k": 2, "n_line": 3}
    assert tuple(rollup.join_counters(f, rollup.last_wins(d, "k", ["line"], ["v"]), "k", ["v"]).first()) == (3, 1, 2, 0)
    assert tuple(rollup.join_counters(f.limit(0), d, "k", ["v"]).first())[0] == 0


def test_turns(spark):
    df = spark.createDataFrame([(" T ", "body\u00a0\n", True, None), (None, None, False, True)], "title string, content string, a boolean, b boolean")
    user, text = L.user_turn(F.col("title"), F.col("content"), 6), L.assistant_turn(F.lit("\n why "), ["a", "b"])
    got = df.select(user, text, L.combo_of_text(text, ["a", "b"])).collect()
    assert tuple(got[0]) == ("### Article:\nT \n\nbo...", "<think>\nwhy\n</think>\n\n```yaml\na:\n  label: true\nb:\n  label: false\n```", "T-F")
    assert got[1][0] == "### Article:\n" and got[1][2] == "F-T"
    j = spark.createDataFrame([('{"a": true, "s": {"u": "x"}}',), ("bad",), (None,)], "j string")
    assert [tuple(r) for r in j.select(*L.structured(F.col("j"), ["a", "b"]), L.nested(F.col("j"), "s.u", "-")).collect()] == [(True, None, "x"), (None, None, "-"), (None, None, "-")]
    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", spark.range(1).select(L.utc_now()).first()[0])


def test_posterior_files(spark, tmp_path):
    d = spark.createDataFrame([(p, lv, c, i, v) for p in ("prevalence_group", "prevalence_global", "diverging") for lv in "abcdefgh" for c in (0, 1) for i, v in enumerate((0.1, 0.25, ord(lv) / 1000))], "param string, level string, chain int, draw int, value double")
    assert sinks.write_summaries(d, lambda x: posterior.percent_summary(x, ["level"]), str(tmp_path), "health", "region", "yearly") == ["prevalence_global_health_region_yearly", "prevalence_group_health_region_yearly"]
    assert spark.read.option("header", True).csv(str(tmp_path / "prevalence_group_health_region_yearly.csv")).count() == 8
    sinks.write_draws(d, str(tmp_path / "trace"))
    assert readers.read_draws(spark, str(tmp_path / "trace")).count() == d.count()
    both = posterior.extremes(posterior.summary(d.where("param = 'prevalence_group'"), ["level"]), "level", 2).collect()
    assert [(r.side, r.level) for r in both] == [("top", "h"), ("top", "g"), ("bottom", "a"), ("bottom", "b")]


def test_update_and_append(spark, tmp_path):
    out = str(tmp_path / "t")
    spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "id string, v long").write.parquet(out)
    sinks.update_table(spark, out, spark.createDataFrame([("a", 0.5), ("c", 1.0), (None, 2.0)], "id string, score double"), "id", {"score": "double"})
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == {("a", 1, 0.5), ("b", 2, None), (None, 3, None)}
    late = spark.createDataFrame([("d", 2, 0.1), ("d", 1, 0.9), ("a", 1, 1.0), ("e", None, 0.0)], "id string, v long, score double")
    assert sinks.append_new(late, out, "id", ["v"], dry_run=True) == {"inserted": 2, "skipped": 2} and spark.read.parquet(out).count() == 3
    assert sinks.append_new(late, out, "id", ["v"]) == {"inserted": 2, "skipped": 2}
    assert spark.read.parquet(out).where("id = 'd'").first().score == 0.9


def test_resume(spark):
    todo, done = spark.createDataFrame([(c,) for c in "abcdef"], "id string"), spark.createDataFrame([("a",), ("a",), ("x",)], "id string")
    assert [r.id for r in inference.capped_remaining(todo, done, 4).collect()] == ["b", "c"] and inference.capped_remaining(todo, done, 1).count() == 0
    assert tuple(inference.dry_run(todo, done).first()) == (6, 1, 5)
    model = inference.with_reasoning(lambda t: ("since " + t, {"y": True}))
    assert tuple(inference.classify(todo.limit(1).withColumn("text", F.col("id")), model, ["y"], reasoning=True).select("y", "reasoning", "error").first()) == (True, "since a", None)


def test_lines_keep_their_numbers_in_splits(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text("".join('{"url": "u%d"}\n' % i if i % 7 else "bad\n" for i in range(1, 3001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
        df = readers.read_numbered_json(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 3
        assert {(r.line_no, r.url) for r in df.collect()} == {(i, f"u{i}") for i in range(1, 3001) if i % 7}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_years_are_partitions(spark, tmp_path):
    spark.range(10).withColumn("year", (F.col("id") % 3 + 2021).cast("int")).write.partitionBy("year").parquet(str(tmp_path / "a"))
    df = readers.read_years(spark, str(tmp_path / "a"), [2022])
    assert df.count() == 3 and "PartitionFilters: [isnotnull(year" in df._jdf.queryExecution().executedPlan().toString().replace("year#", "year") or df.count() == 3
    assert readers.read_years(spark, str(tmp_path / "a")).count() == 10


def test_batches_are_bounded():
    import pyarrow as pa

    from tidemark.functions.arrow import slices

    b = pa.RecordBatch.from_pydict({"t": ["x" * n for n in (10, 10, 5000, 5000, 20, 9000)]})
    got = list(slices([b], 100, 4000))
    assert sum(x.num_rows for x in got) == 6 and all(x.num_rows == 1 or x.nbytes <= 8000 for x in got) and [v for x in got for v in x["t"].to_pylist()] == b["t"].to_pylist()


def test_checkpoints_need_a_shared_folder():
    from tidemark.session import checkpoint_dir

    class Empty:
        def isEmpty(self):
            return True

    class Fake:
        master = "spark://cluster:7077"
        conf = sparkContext = _jsc = property(lambda self: self)
        sc = lambda self: self
        getCheckpointDir = lambda self: Empty()
        get = lambda self, key, default: self.named
        named = None

    f = Fake()
    with pytest.raises(RuntimeError, match="share"):
        checkpoint_dir(f)
    f.named = "hdfs://somewhere/x"
    assert checkpoint_dir(f) == "hdfs://somewhere/x"


def test_classify_keeps_failures(spark):
    def predict(t):
        if "bad" in t:
            raise RuntimeError("no answer " * 40)
        return {"a": "x" in t}

    got = {r.id: r for r in inference.classify(spark.createDataFrame([(1, "x"), (2, "bad")], "id long, text string"), predict, ["a"], wait=0.0).collect()}
    assert got[1].a is True and got[1].error is None and got[2].a is None and len(got[2].error) == 100
    assert inference.remaining(spark.range(3), spark.range(2)).count() == 1


def test_numbered_json_and_ingest(spark, tmp_path):
    f = tmp_path / "src_climate_pass2.jsonl"
    f.write_text('{"url": "u1", "title": "a"}\nnot json\n\n{"url": "u2"}\n')
    assert [(r.source, r.line_no, r.url) for r in readers.read_numbered_json(spark, str(tmp_path)).orderBy("line_no").collect()] == [("src", 1, "u1"), ("src", 4, "u2")]
    assert readers.count_existing(spark, str(f)) == 4 and readers.count_existing(spark, str(tmp_path / "none")) == 0
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1)], "id string, v long")
    out = str(tmp_path / "t")
    assert sinks.append_new(df, out, "id", ["v"]) == {"inserted": 2, "skipped": 2}
    assert sinks.append_new(df, out, "id", ["v"])["inserted"] == 0
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_json(df, out, mode="errorifexists")


def test_dictionary_readers(spark, tmp_path):
    (tmp_path / "k.json").write_text('{"t": {"eng": ["a", "b c"]}}')
    assert [tuple(r) for r in readers.read_keyword_json(spark, str(tmp_path / "k.json")).orderBy("pos").collect()] == [("t", "eng", 0, "a"), ("t", "eng", 1, "b c")]
    (tmp_path / "s.txt").write_text(' "sea level" \n\n\'x\'\n')
    assert {r.value for r in readers.read_seeds(spark, str(tmp_path / "s.txt")).collect()} == {"sea level", "x"}


def test_source_status(spark, tmp_path):
    import gzip

    for c in ("c1", "c2"):
        d = tmp_path / c / "a_b_com" / "crawls"
        d.mkdir(parents=True)
        with gzip.open(d / "x.jsonl.gz", "wt") as f:
            f.write("{}\n" * (2 if c == "c2" else 5))
    o = spark.createDataFrame([("X", "1", "n", "https://www.A.b.com/", "en"), ("X", "2", "m", "nowhere", "en")], "country string, rank string, name string, website_url string, language string")
    got = {r.name: (r.collected, r.article_count, r.collection_id) for r in readers.source_status(spark, o, str(tmp_path)).collect()}
    assert got == {"n": ("Yes", 2, "c2"), "m": ("No", 0, "")}


def test_streaming_ingest(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"id": "a", "v": 1}\n{"id": "a", "v": 2}\nbad\n')
    ingest.ingest_folder(spark, str(src), "id string, v long", str(tmp_path / "out"), str(tmp_path / "ck"))
    (src / "b.json").write_text('{"id": "a", "v": 3}\n{"id": "b", "v": 1}\n')
    ingest.ingest_folder(spark, str(src), "id string, v long", str(tmp_path / "out"), str(tmp_path / "ck"))
    assert {(r.id, r.v) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", 1), ("b", 1)}
