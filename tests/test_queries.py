"""Every query of the corpus plans against its SQL on the smallest tables."""

import math
import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tidemark.plans import corpus

DATA = Path(os.environ.get("TIDEMARK_DATA", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")
Q, SQL = corpus.queries(), corpus.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return None
    v = v.item() if hasattr(v, "item") else v
    return round(v, 5) if isinstance(v, float) and math.isfinite(v) else v


def rows(pdf, cols):
    return sorted(repr(tuple(plain(v) for v in r)) for r in pdf[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    a = Q[name](spark, str(DATA)).toPandas()
    b = con.execute(SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a, sorted(a.columns)) == rows(b, sorted(a.columns))


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL) - {"hierarchical_prevalence", "hierarchical_time"}))
def test_runs(spark, name):
    assert Q[name](spark, str(DATA)).count() > 0


def test_chat_messages_hold_the_whole_content(spark, con):
    from pyspark.sql import functions as F

    turn = F.get_json_object("messages", "$[1].content")
    got = {r.id: r.turn for r in Q["chat_messages"](spark, str(DATA)).select("id", turn.alias("turn")).collect()}
    whole = con.execute("SELECT DISTINCT id, content FROM articles WHERE id IN (SELECT id FROM classifications) AND length(content) > 40").fetchall()
    assert whole and all((content.strip()[:10_000]) in got[i] for i, content in whole)


def test_diagnostics_cover_every_position(spark, con):
    n = con.execute("SELECT max(len(embedding)) FROM embeddings").fetchone()[0]
    got = Q["split_rhat"](spark, str(DATA)).toPandas()
    assert set(got["param"]) == {f"e{i}" for i in range(n)}
    worst = Q["worst_diagnostics"](spark, str(DATA)).toPandas().iloc[0]
    assert worst["max_r_hat"] == pytest.approx(got["r_hat"].max()) and worst["min_ess_bulk"] == pytest.approx(got["ess_bulk"].min())


def test_published_months_reads_every_form(spark, tmp_path):
    values = ["2022-01-05T10:00:00Z", "Wed, 05 Jan 2022 10:00:00 +0000", "2022-01-01T00:30:00+02:00", "2022-01-05", "2022-01", "1641376800", "2021-10-31 01:45", "2022-02-30", "bad", "", None]
    a = [(f"a{i}", "London", "page", v, None, "GB") for i, v in enumerate(values)]
    spark.createDataFrame(a + a[:3], "id string, source_uri string, collection_method string, published_date string, extracted_at string, country string").write.parquet(f"{tmp_path}/articles.parquet")
    spark.createDataFrame([(f"a{i}", True, i == 0, False, False) for i in range(len(values))], "id string, " + ", ".join(f"{c} boolean" for c in corpus.LABELS)).write.parquet(f"{tmp_path}/classifications.parquet")
    spark.createDataFrame([("London", "Europe/London", "en-GB")], "source_uri string, zone_name string, locale string").write.parquet(f"{tmp_path}/source_clocks.parquet")
    spark.createDataFrame([("page", "UTC", True)], "collection_method string, zone_name string, is_page boolean").write.parquet(f"{tmp_path}/collector_clocks.parquet")
    got = {(r.month, r.country, r.n_cc, r.n_cc_health) for r in Q["published_months"](spark, str(tmp_path)).collect()}
    assert got == {("2022-01", "GB", 5, 1), ("2021-12", "GB", 1, 0), ("2021-10", "GB", 1, 0)}


def test_hierarchical_prevalence_pools_sources(spark, monkeypatch):
    """One row per source reaches the sampler, with its own number of draws and tuning steps."""
    from tidemark.operators import rollup, sampler

    seen, real = [], sampler.hierarchical_prevalence
    monkeypatch.setattr(sampler, "hierarchical_prevalence", lambda stats, **kw: seen.append((stats, kw)) or real(stats, **kw))
    got = corpus.queries()["hierarchical_prevalence"](spark, str(DATA)).toPandas()
    (stats, kw), = seen
    assert kw.get("draws", 500) >= 500 and kw.get("tune", 500) >= 500 and set(got["n"]) == {4 * 500} and "diverging" not in set(got["param"])
    assert stats.count() == rollup.sufficient_stats(corpus.cells(spark, str(DATA)), ["source", "country", "grp"], "k_hecc_cc", "n_cc").count()


def test_article_cube_like_pandas(spark, con):
    """The cube of the articles against pandas, for the dates it reads as well (those with a zone or in ISO order)."""
    a = con.execute("SELECT DISTINCT id, source_uri, country, published_date FROM articles").df().merge(con.execute("SELECT id, " + ", ".join(f"bool_or({c}) AS {c}" for c in corpus.LABELS) + " FROM classifications WHERE id IS NOT NULL GROUP BY id").df(), on="id", how="left")
    months = {(r.id, r.value): r.month for r in corpus.month_of_value(spark, str(DATA)).collect()}
    a["month"] = [months.get((i, v)) for i, v in zip(a["id"], a["published_date"])]
    iso = a["published_date"].str.fullmatch(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})").eq(True)
    read = pd.to_datetime(a["published_date"][iso], utc=True, format="mixed", errors="coerce").dt.strftime("%Y-%m")
    assert iso.sum() > 20 and (a["month"][iso] == read).all()
    a["country"] = a["country"].replace({"GB": "United Kingdom"})
    known = set(con.execute("SELECT DISTINCT country FROM source_languages WHERE country <> ''").df()["country"])
    a = a[a["country"].isin(known) & a["month"].between("2021-01", "2025-12") & a["source_uri"].notna()]
    cc = a["climate_change"].eq(True)
    want = a.assign(cc=cc, k=cc & a["health"].eq(True)).groupby(["source_uri", "country", "month"]).agg(n_total=("id", "size"), n_cc=("cc", "sum"), k=("k", "sum")).reset_index()
    got = Q["master_cube_articles"](spark, str(DATA)).toPandas()
    assert list(got.columns)[:4] == ["source_uri", "country", "iso3", "month"] and got["iso3"].notna().all()
    assert sorted(map(tuple, got[["source_uri", "country", "month", "n_total", "n_cc", "k_health_cc"]].values.tolist())) == sorted(map(tuple, want.values.tolist()))
    assert got[["country", "source_uri", "month"]].values.tolist() == sorted(got[["country", "source_uri", "month"]].values.tolist())
