"""Queries over the corpus tables, with the SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import labels as L
from tidemark.functions import text as X
from tidemark.operators import inference, keywords, metrics, posterior, rollup, sampler, sampling, timestamps
from tidemark.session import table
from tidemark.sources import sinks
from tidemark.streaming import ingest

LABELS = ["climate_change", "health", "health_effects_of_climate_change", "health_effects_of_extreme_weather"]
AVAILABLE = ["eng", "spa", "deu", "fra"]
FALLBACK = {"por": "spa", "rus": "eng"}
STUB = {"climate_change": ["drought", "sequía", "seca", "sécheresse"], "health": ["clinic", "health", "clínica"]}
SCORES = ["bm25_climate", "bm25_health", "bm25_avg"]


# ---- shared inputs


def facts(s, d) -> DataFrame:
    """Line items in the role of labelled documents: source, country, group, month and three labels."""
    li, su, na, re_ = (table(s, d, n) for n in ("lineitem", "supplier", "nation", "region"))
    dim = su.join(na, su.s_nationkey == na.n_nationkey).join(re_, na.n_regionkey == re_.r_regionkey).select("s_suppkey", "n_name", "r_name")
    x = li.select("l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate").join(dim, li.l_suppkey == dim.s_suppkey)
    return x.select(
        F.col("l_suppkey").alias("source"), F.col("n_name").alias("country"), F.col("r_name").alias("grp"), F.date_format("l_shipdate", "yyyy-MM").alias("month"),
        (F.col("l_returnflag") != "N").alias("cc"), (F.col("l_returnflag") == "R").alias("hecc"), (F.col("l_linestatus") == "F").alias("health"),
    )


FACTS = """facts AS (
  SELECT l_suppkey AS source, n_name AS country, r_name AS grp, strftime(l_shipdate, '%Y-%m') AS month,
         l_returnflag <> 'N' AS cc, l_returnflag = 'R' AS hecc, l_linestatus = 'F' AS health
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
CELLS = f"""{FACTS}, cells AS (
  SELECT source, country, grp, month, count(*) AS n_total, count(*) FILTER (cc) AS n_cc,
         count(*) FILTER (cc AND hecc) AS k_hecc_cc, count(*) FILTER (cc AND health) AS k_health_cc
  FROM facts WHERE source IS NOT NULL AND country IS NOT NULL AND grp IS NOT NULL AND month IS NOT NULL GROUP BY ALL)"""


def cells(s, d) -> DataFrame:
    return rollup.cell_rollup(facts(s, d), ["source", "country", "grp", "month"], F.col("cc"), {"k_hecc_cc": F.col("hecc"), "k_health_cc": F.col("health")})


def articles(s, d, *cols) -> DataFrame:
    """Distinct articles: exact copies of a row are one article."""
    return table(s, d, "articles").select("id", *[c for c in cols if c != "id"]).dropDuplicates(["id"] if not cols else None)


def labelled(s, d) -> DataFrame:
    """One row per classified id; of repeated labels a stated true wins over false, false over missing."""
    return table(s, d, "classifications").where("id is not null").groupBy("id").agg(*[F.max(c).alias(c) for c in LABELS])


LABELLED = "labelled AS (SELECT id, " + ", ".join(f"bool_or({c}) AS {c}" for c in LABELS) + " FROM classifications WHERE id IS NOT NULL GROUP BY id)"


def predicted(s, d) -> DataFrame:
    """Truth and a made-up prediction that differs from it where a digit of the id's MD5 is 0 and is missing where it is 1."""
    x = labelled(s, d)
    cols = {}
    for i, c in enumerate(LABELS):
        digit = F.substring(F.md5("id"), i + 1, 1)
        truth = F.coalesce(F.col(c), F.lit(False))
        cols["t_" + c] = truth
        cols["p_" + c] = L.penalised(F.when(digit == "1", F.lit(None).cast("boolean")).when(digit == "0", ~truth).otherwise(truth), truth)
    x = x.select("id", *[v.alias(k) for k, v in cols.items()])
    none = lambda p: ~(F.col(p + LABELS[0]) | F.col(p + LABELS[1]) | F.col(p + LABELS[2]) | F.col(p + LABELS[3]))
    return x.withColumns({"t_none": none("t_"), "p_none": none("p_")})


PAIRS = {c: ("p_" + c, "t_" + c) for c in LABELS}
PREDICTED = LABELLED + ", truth AS (SELECT id, md5(id) AS h, " + ", ".join(f"coalesce({c}, false) AS t_{c}" for c in LABELS) + " FROM labelled), predicted AS (SELECT *, " + ", ".join(
    f"CASE WHEN substr(h, {i + 1}, 1) IN ('0', '1') THEN NOT t_{c} ELSE t_{c} END AS p_{c}" for i, c in enumerate(LABELS)
) + " FROM truth)"
LONG = PREDICTED + ", pn AS (SELECT *, NOT (" + " OR ".join("t_" + c for c in LABELS) + ") AS t_none, NOT (" + " OR ".join("p_" + c for c in LABELS) + ") AS p_none FROM predicted), long AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS label, p_{c} AS p, t_{c} AS t FROM pn" for c in [*LABELS, "none"]
) + ")"


def topic_terms(s, d, langs: list[str] | None = None) -> dict:
    k = table(s, d, "keywords")
    k = k.where(F.col("lang").isin(langs)) if langs else k
    return {t: {lang: list(dict.fromkeys(x.lower() if lang not in X.CJK else x for x in ts)) for lang, ts in keywords.term_lists(k, t).items()} for t in ("climate", "health")}


def documents(s, d) -> DataFrame:
    return table(s, d, "documents").where("text is not null and lang is not null").select("doc_id", "text", "lang", "source")


def matched(s, d) -> DataFrame:
    return X.hits(documents(s, d), topic_terms(s, d), "doc_id", "text", "lang")


# Hits by tokens: the terms of the oracle's dictionary are looked up as sequences of word tokens with their separators kept.
def hits_sql(lang: str = "lang", langs: str = "SELECT lang FROM keywords") -> str:
    return r"""terms AS (SELECT DISTINCT topic, lang, CASE WHEN lang = 'zho' THEN term ELSE lower(term) END AS term FROM keywords WHERE term IS NOT NULL AND lang IN (""" + langs + r""")),
docs AS (SELECT doc_id, lang, source, text, lower(text) AS low FROM (SELECT doc_id, """ + lang + r""" AS lang, source, text FROM documents) WHERE text IS NOT NULL AND lang IN (SELECT lang FROM terms)),
marked AS (SELECT doc_id, lang, text, regexp_replace(low, '([\p{L}\p{N}_]+)', chr(1) || '\1' || chr(2), 'g') AS m FROM docs),
hits AS (
  SELECT m.doc_id, t.topic, t.lang, t.term, CAST(CASE WHEN t.lang = 'zho' THEN (length(text) - length(replace(text, term, ''))) / length(term)
    ELSE (length(m) - length(replace(m, regexp_replace(term, '([\p{L}\p{N}_]+)', chr(1) || '\1' || chr(2), 'g'), ''))) / length(regexp_replace(term, '([\p{L}\p{N}_]+)', chr(1) || '\1' || chr(2), 'g')) END AS BIGINT) AS tf
  FROM marked m JOIN terms t ON m.lang = t.lang),
lengths AS (SELECT doc_id, lang, CAST(CASE WHEN lang = 'zho' THEN length(text) ELSE len(list_filter(regexp_split_to_array(text, '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x <> '')) END AS BIGINT) AS dl FROM docs)"""


HITS = hits_sql()
SCORED = """, found AS (SELECT * FROM hits WHERE tf > 0), df AS (SELECT topic, lang, term, count(*) AS df FROM found GROUP BY ALL),
stats AS (SELECT lang, count(*) AS n_docs, avg(dl) AS avg_dl FROM lengths GROUP BY lang),
scored AS (SELECT f.doc_id, f.topic, sum(ln((n_docs - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_dl))) AS s
  FROM found f JOIN df ON f.topic = df.topic AND f.lang = df.lang AND f.term = df.term JOIN lengths l ON f.doc_id = l.doc_id JOIN stats ON stats.lang = f.lang GROUP BY ALL),
bm AS (SELECT l.doc_id, l.lang, coalesce((SELECT max(s) FROM scored x WHERE x.doc_id = l.doc_id AND topic = 'climate'), 0.0) AS c, coalesce((SELECT max(s) FROM scored x WHERE x.doc_id = l.doc_id AND topic = 'health'), 0.0) AS h FROM lengths l)"""
BM25 = HITS + SCORED
RESOLVED = "CASE WHEN lang IN ('eng', 'spa', 'deu', 'fra') THEN lang WHEN lang = 'por' THEN 'spa' WHEN lang = 'rus' THEN 'eng' END"


def scored(s, d) -> DataFrame:
    return X.bm25(matched(s, d), "doc_id", "lang", ["climate", "health"])


def score_update(s, d) -> DataFrame:
    """Documents with three score columns added and set by key; languages without a dictionary take their fallback's, others stay null."""
    docs = X.resolved_language(table(s, d, "documents").where("text is not null").select("doc_id", "text", "lang"), "lang", AVAILABLE, FALLBACK).where("resolved is not null")
    scores = X.bm25(X.hits(docs, topic_terms(s, d, AVAILABLE), "doc_id", "text", "resolved"), "doc_id", "resolved", ["climate", "health"])
    target = sinks.with_columns(table(s, d, "documents").select("doc_id", "lang"), dict.fromkeys(SCORES, "double"))
    return sinks.updated(target, scores.select("doc_id", *[F.round(c, 5).alias(c) for c in SCORES]), "doc_id", SCORES)


def covariates(s, d) -> DataFrame:
    """Country covariates: guidance joined by code, one country that it lacks and one value set by hand, marks of absence emptied."""
    old = dim(s, d).where("country <> ''").select("country").distinct().withColumn("lc_region", F.lit("stale"))
    c = rollup.without(old, ["lc_region", "who_region", "hdi_2025"]).withColumn("iso3", F.upper(F.substring("country", 1, 3)))
    na, re_ = table(s, d, "nation"), table(s, d, "region")
    groups = na.join(re_, na.n_regionkey == re_.r_regionkey).select(F.col("n_nationkey").alias("__n"), F.col("r_name").alias("lc_region"), F.concat(F.lit("WHO "), F.col("n_regionkey").cast("string")).alias("who_region"))
    hdi = F.element_at(F.array(*map(F.lit, ["#N/A", "High", "Low"])), (F.length("country") % 3 + 1).cast("int"))
    guidance = c.where("iso3 <> 'SIN'").select("iso3", F.length("country").alias("__n"), hdi.alias("hdi_2025")).join(groups, "__n").drop("__n")
    x = rollup.left_attributes(c, guidance, "iso3")
    x = rollup.override(x, "iso3", "SIN", {"lc_region": "ASIA", "who_region": "Western Pacific", "hdi_2025": ""})
    x = rollup.override(x, "iso3", "KEN", {"hdi_2025": ""})
    return x.withColumn("hdi_2025", F.when(F.col("hdi_2025") == "#N/A", "").otherwise(F.coalesce("hdi_2025", F.lit(""))))


COVARIATES = """cov0 AS (SELECT DISTINCT country, upper(substr(country, 1, 3)) AS iso3, CASE length(country) % 3 WHEN 0 THEN '#N/A' WHEN 1 THEN 'High' ELSE 'Low' END AS hdi, length(country) AS n FROM source_languages WHERE country <> ''),
guide AS (SELECT iso3, arg_min(struct_pack(hdi, r_name, k := n_regionkey), struct_pack(hdi, r_name, k := n_regionkey)) AS g FROM cov0 JOIN nation ON n_nationkey = n JOIN region ON n_regionkey = r_regionkey WHERE iso3 <> 'SIN' GROUP BY iso3),
cov AS (SELECT country, iso3, CASE WHEN iso3 = 'SIN' THEN 'ASIA' ELSE g.r_name END AS lc_region, CASE WHEN iso3 = 'SIN' THEN 'Western Pacific' ELSE 'WHO ' || g.k END AS who_region,
  CASE WHEN iso3 IN ('SIN', 'KEN') OR g.hdi = '#N/A' THEN '' ELSE coalesce(g.hdi, '') END AS hdi_2025 FROM cov0 LEFT JOIN guide USING (iso3))"""


def master_cube(rows: DataFrame, cov: DataFrame) -> DataFrame:
    """Sorted cells of source, country and month from 2021-01 to 2025-12, for the countries of the covariates, with these joined on."""
    x = rows.withColumn("country", F.when(F.col("country") == "GB", "United Kingdom").otherwise(F.col("country")))
    x = rollup.members(x, cov, "country").where(F.col("month").between("2021-01", "2025-12"))
    cube = rollup.cell_rollup(x, ["source_uri", "country", "month"], F.col("climate_change"), {"k_hecc_cc": F.col("hecc"), "k_health_cc": F.col("health")})
    order = ["source_uri", "country", "iso3", "month", "lc_region", "who_region", "hdi_2025", "n_total", "n_cc", "k_hecc_cc", "k_health_cc"]
    return rollup.left_attributes(cube, cov, "country").select(*order).orderBy("country", "source_uri", "month")


def document_cube(s, d) -> DataFrame:
    """The cube of the documents, whose topic stands for labels and whose time is an instant."""
    topic = F.coalesce("topic", F.lit(""))
    rows = table(s, d, "documents").select(
        F.col("source").alias("source_uri"), "country", F.date_format("published_at", "yyyy-MM").alias("month"), topic.isin("climate", "both").alias("climate_change"),
        topic.isin("health", "both").alias("health"), (topic == "both").alias("hecc"),
    )
    return master_cube(rows, covariates(s, d))


def article_cube(s, d) -> DataFrame:
    """The cube of the classified articles; months of dates in every readable form."""
    a = articles(s, d, "source_uri", "country", "published_date").join(labelled(s, d), "id", "left").withColumnRenamed("published_date", "value").join(month_of_value(s, d), ["id", "value"])
    return master_cube(a.withColumnRenamed("health_effects_of_climate_change", "hecc"), covariates(s, d))


def annotations(s, d) -> DataFrame:
    """Classifications in the role of annotation lines: the last of an id, by the order of its labels, wins."""
    c = table(s, d, "classifications")
    line = F.concat_ws("", *[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in LABELS])
    return rollup.last_wins(c.withColumn("line", line), "id", ["line"], LABELS)


ANNOTATIONS = "ann AS (SELECT id, " + ", ".join(f"arg_max(coalesce(CAST({c} AS VARCHAR), '-'), line) AS {c}" for c in LABELS) + " FROM (SELECT *, concat_ws('', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in LABELS) + ") AS line FROM classifications WHERE id IS NOT NULL) GROUP BY id)"


def chat_turns(s, d) -> DataFrame:
    """Texts of the fine-tuning turns of the articles whose annotation states every label."""
    a = articles(s, d, "title", "content").join(rollup.require_keys(annotations(s, d), LABELS), "id")
    return a.select("id", L.user_turn(F.col("title"), F.col("content"), 10_000).alias("user_text"), L.assistant_turn(F.lit(" short \n"), LABELS).alias("assistant_text"))


def score_bins(s, d) -> DataFrame:
    """Articles per language group (the ten most frequent, else other) and size bin (by the terciles of the length)."""
    a = articles(s, d, "language", "content").where("length(content) > 0").withColumn("n", F.length("content"))
    low, high = sampling.thresholds(a, "n")
    lang = sampling.top_or_other(F.col("language"), sampling.most_frequent(a, "language", 10))
    return a.groupBy(lang.alias("lang_group"), sampling.binned(F.col("n"), F.lit(low), F.lit(high)).alias("size_bin")).agg(F.count(F.lit(1)).alias("n"))


def strata(s, d) -> DataFrame:
    """Articles with language group, year and content-size bin."""
    a = articles(s, d, "language", "country", "published_date", "content").where("length(content) > 0 and country is not null")
    n = F.length("content")
    lang = F.when(F.col("language").isin("eng", "spa", "por", "fra"), F.col("language")).otherwise("other")
    year = F.coalesce(F.expr("try_cast(substr(published_date, 1, 4) as int)"), F.lit(0))
    return a.select("id", "country", lang.alias("lang_group"), F.when(year.between(2020, 2030), year).otherwise(0).alias("year"), sampling.binned(n, F.lit(1200), F.lit(2200)).alias("size_bin"))


STRATA = """rows AS (SELECT DISTINCT id, country, CASE WHEN language IN ('eng', 'spa', 'por', 'fra') THEN language ELSE 'other' END AS lang_group,
  CASE WHEN coalesce(try_cast(substr(published_date, 1, 4) AS INTEGER), 0) BETWEEN 2020 AND 2030 THEN try_cast(substr(published_date, 1, 4) AS INTEGER) ELSE 0 END AS year,
  CASE WHEN length(content) < 1200 THEN 'low' WHEN length(content) < 2200 THEN 'medium' ELSE 'high' END AS size_bin
  FROM articles WHERE length(content) > 0 AND country IS NOT NULL), strata AS (SELECT lang_group, year, size_bin, count(*) AS size FROM rows GROUP BY ALL)"""
ALLOCATION = STRATA + """, t AS (SELECT *, count(*) OVER () AS ns, sum(size) OVER () AS total FROM strata),
q AS (SELECT *, least(size, 3 + CAST(round_even(CAST(greatest(0, 300 - ns * 3) * size AS DOUBLE) / total, 0) AS BIGINT)) AS q FROM t),
g AS (SELECT *, greatest(0, 300 - sum(q) OVER ()) AS gap, size - q AS room FROM q),
u AS (SELECT *, coalesce(sum(room) OVER (ORDER BY size DESC, lang_group, year, size_bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM g),
plan AS (SELECT lang_group, year, size_bin, size, CAST(q + greatest(0, least(room, gap - used)) AS BIGINT) AS n_sample FROM u)"""
STRATUM = ["lang_group", "year", "size_bin"]


def plan(s, d) -> DataFrame:
    return sampling.allocation(strata(s, d).groupBy(*STRATUM).agg(F.count(F.lit(1)).alias("size")), STRATUM, "size", 300, 3)


def draws(s, d) -> DataFrame:
    """Vector elements in the role of draws: element = parameter, label = group, id = chain and draw."""
    e = table(s, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "value"))
    return e.select(F.concat(F.lit("e"), "pos").alias("param"), F.concat(F.lit("g"), "label").alias("grp"), F.col("pos").alias("level"), F.pmod("vec_id", F.lit(4)).cast("int").alias("chain"),
                    F.floor(F.col("vec_id") / 4).cast("int").alias("draw"), F.col("value").cast("double").alias("value"))


DRAWS = """draws AS (SELECT 'e' || pos AS param, 'g' || label AS grp, pos AS level, vec_id % 4 AS chain, vec_id // 4 AS draw, CAST(embedding[pos + 1] AS DOUBLE) AS value
  FROM embeddings, (SELECT unnest(range((SELECT max(len(embedding)) FROM embeddings))) AS pos) WHERE pos < len(embedding))"""


def summary_sql(src: str, keys: str, scale: str = "1.0") -> str:
    on = " AND ".join(f"x.{k.strip()} = m.{k.strip()}" for k in keys.split(","))
    mk = ", ".join(f"x.{k.strip()}" for k in keys.split(","))
    return f"""x AS (SELECT {keys}, value * {scale} AS value FROM {src}), m AS (SELECT {keys}, count(*) AS n, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM x GROUP BY ALL)
SELECT {mk}, max(m.n) AS n, round(max(med), 6) AS median, round(quantile_cont(abs(value - med), 0.5), 6) AS mad, round(max(lo), 6) AS eti_low, round(max(hi), 6) AS eti_high FROM x JOIN m ON {on} GROUP BY {mk}"""


def cot(s, d) -> DataFrame:
    """Responses built from the labels: a think block that names a label, then the label block; every seventh lacks one."""
    x = labelled(s, d)
    text = F.concat(F.lit("<think>health:\n label: true</think>\n"), L.label_block(LABELS))
    return x.select("id", F.when(F.substring(F.md5("id"), 1, 1) == "a", F.lit("<think>none</think> unsure")).otherwise(text).alias("response"))


def month_of_value(s, d) -> DataFrame:
    """(id, value, month) of every readable published_date: the UTC month of its instant; where the clock leaves that open, the month as written."""
    a = articles(s, d, "source_uri", "collection_method", "published_date", "extracted_at")
    w = timestamps.written_instants(a, table(s, d, "source_clocks"), table(s, d, "collector_clocks")).where("field_name = 'published_date'")
    month = lambda x, rank: x.select("id", "value", F.substring("utc_text", 1, 7).alias("month"), F.lit(rank).alias("rank"))
    at, wall = (month(timestamps.utc_text(x, ["id", "value"]), n) for n, x in enumerate((w, w.withColumn("zone", F.lit("UTC")))))
    day = month(w.where(F.col("value").rlike(r"^\d{4}-\d{2}(-\d{2})?$")).withColumn("utc_text", F.expr("date_format(try_cast(value AS date), 'yyyy-MM')")).where("utc_text is not null"), 2)
    return at.union(wall).union(day).groupBy("id", "value").agg(F.min_by("month", "rank").alias("month"))


def published_months(s, d) -> DataFrame:
    a = articles(s, d, "country", "published_date").join(labelled(s, d), "id").where(F.coalesce("climate_change", F.lit(False)) & F.col("country").isNotNull())
    x = a.withColumnRenamed("published_date", "value").join(month_of_value(s, d), ["id", "value"])
    return x.groupBy("month", "country").agg(F.count(F.lit(1)).alias("n_cc"), rollup.count_true(F.col("health")).alias("n_cc_health"))


def dim(s, d) -> DataFrame:
    return table(s, d, "source_languages")


def keyword_articles(s, d, topic: str = "climate") -> DataFrame:
    """Articles that hold a term of their language's united list; a language is told by its code or English name."""
    terms = keywords.term_lists(keywords.with_english(table(s, d, "keywords")), topic)
    a = articles(s, d, "title", "content", "language").where("content is not null and content <> ''")
    lang = F.coalesce(F.nullif(X.language_code(F.col("language")), F.lit("")), F.col("language"))
    return a.where(X.keyword_match(X.full_text(F.col("title"), F.col("content")), lang, terms)).select("id")


def stub_classified(s, d) -> DataFrame:
    docs = table(s, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text")
    return inference.classify(docs, inference.keyword_stub(STUB), list(STUB), wait=0.0)


def queries() -> dict:
    t = table
    K4 = ["source", "country", "grp"]
    q = {
        "p2_found": lambda s, d: timestamps.p2_found(t(s, d, "articles"), t(s, d, "source_clocks"), t(s, d, "collector_clocks")),
        "p2_zones": lambda s, d: timestamps.p2_zones(t(s, d, "source_clocks"), t(s, d, "collector_clocks")),
        "p2_utc": lambda s, d: timestamps.p2_utc(t(s, d, "articles"), t(s, d, "source_clocks"), t(s, d, "collector_clocks")),
        "master_cube": document_cube,
        "master_cube_articles": article_cube,
        "country_covariates": covariates,
        "score_update": score_update,
        "united_keywords": lambda s, d: keywords.with_english(t(s, d, "keywords")),
        "annotation_join": lambda s, d: articles(s, d).join(rollup.require_keys(annotations(s, d), LABELS), "id"),
        "annotation_counters": lambda s, d: rollup.join_counters(articles(s, d), annotations(s, d), "id", LABELS),
        "chat_turns": chat_turns,
        "combo_from_text": lambda s, d: chat_turns(s, d).groupBy(L.combo_of_text(F.col("assistant_text"), LABELS).alias("combo")).agg(F.count(F.lit(1)).alias("n")),
        "optional_predicates": lambda s, d: rollup.where_given(articles(s, d, "language", "source_uri", "collection_method"), {"language": "eng", "source_uri": None}, {"collection_method": []}, {"source_uri": ["gulquidaily.test"]}).groupBy("collection_method").agg(F.count(F.lit(1)).alias("n")),
        "distinct_counts": lambda s, d: rollup.distinct_counts(t(s, d, "articles"), ["id", "country", "language"], ["source_uri"]),
        "language_codes": lambda s, d: articles(s, d, "language").groupBy(X.language_code(F.col("language")).alias("code")).agg(F.count(F.lit(1)).alias("n")),
        "structured_labels": lambda s, d: labelled(s, d).select("id", F.to_json(F.struct(*LABELS[:2])).alias("pred")).select("id", *L.structured(F.col("pred"), LABELS)),
        "nested_values": lambda s, d: t(s, d, "source_languages").select("source_uri", F.to_json(F.struct(F.struct(F.nullif("language_code", F.lit("")).alias("code")).alias("source"))).alias("j")).select("source_uri", L.nested(F.col("j"), "source.code").alias("code"), L.nested(F.col("j"), "other.code", "none").alias("other")),
        "capped_resume": lambda s, d: inference.capped_remaining(articles(s, d), t(s, d, "classifications").where("id is not null"), t(s, d, "classifications").where("id is not null").select("id").distinct().count() + 7),
        "dry_run": lambda s, d: inference.dry_run(articles(s, d), t(s, d, "classifications").where("id is not null")),
        "run_matrix": lambda s, d: sampler.run_matrix(s),
        "score_bins": score_bins,
        "first_sources": lambda s, d: sampling.first_sources(t(s, d, "articles").select("source_uri", "id"), "source_uri", 5, ["babre-courier.invalid"]).groupBy("source_uri").agg(F.count(F.lit(1)).alias("n")),
        "stats_by_period": lambda s, d: rollup.stats_from_rows(facts(s, d).where("cc").withColumn("time_period", rollup.period_label(F.to_timestamp(F.concat("month", F.lit("-01"))), "quarterly")), [*K4, "time_period"], F.col("health")),
        "posterior_extremes": lambda s, d: posterior.extremes(posterior.summary(draws(s, d), ["param"]), "param"),
        "windowed_counts": lambda s, d: ingest.windowed_counts(t(s, d, "events"), "ts", "event_type"),
        "current_time": lambda s, d: t(s, d, "events").select(L.utc_now(F.max("ts")).alias("at")),
        "monthly_cell_rollup": cells,
        "sufficient_stats_yearly": lambda s, d: rollup.sufficient_stats(cells(s, d).withColumn("year", F.substring("month", 1, 4)), [*K4, "year"], "k_hecc_cc", "n_cc"),
        "sufficient_stats_monthly": lambda s, d: rollup.sufficient_stats(cells(s, d), [*K4, "month"], "k_hecc_cc", "n_cc"),
        "sufficient_stats_no_time": lambda s, d: rollup.sufficient_stats(cells(s, d), K4, "k_health_cc", "n_cc"),
        "stats_from_rows": lambda s, d: rollup.stats_from_rows(facts(s, d).where("cc"), K4, F.col("health")),
        "global_monthly_counts": lambda s, d: facts(s, d).where("cc").groupBy(F.concat("month", F.lit("-01")).alias("month")).agg(
            F.count(F.lit(1)).alias("n_cc"), rollup.count_true(F.col("health")).alias("n_cc_health"), rollup.count_true(F.col("hecc")).alias("n_cc_hecc")),
        "monthly_shares": lambda s, d: rollup.shares(q["global_monthly_counts"](s, d), "n_cc", {"pct_health": "n_cc_health", "pct_hecc": "n_cc_hecc"}).select("month", "pct_health", "pct_hecc", "difference"),
        "period_labels": lambda s, d: t(s, d, "orders").select(*[rollup.period_label(F.col("o_orderdate"), g).alias(g) for g in ("yearly", "quarterly", "monthly")]).groupBy("yearly", "quarterly", "monthly").agg(F.count(F.lit(1)).alias("n")),
        "min_volume_filter": lambda s, d: rollup.min_volume(t(s, d, "articles").where("source_uri is not null").select("id", "source_uri"), "source_uri", 30).groupBy("source_uri").agg(F.count(F.lit(1)).alias("n")),
        "any_label_selection": lambda s, d: articles(s, d, "published_date", "language").join(labelled(s, d), "id").where(rollup.any_true(LABELS) & F.substring("published_date", 1, 4).isin("2021", "2022", "2023", "2024", "2025")).select("id", "language", *LABELS),
        "modal_country_per_source": lambda s, d: rollup.modal_value(t(s, d, "articles").select("source_uri", "country"), "source_uri", "country"),
        "dense_level_index": lambda s, d: rollup.dense_index(dim(s, d), "country"),
        "raw_prevalence": lambda s, d: rollup.raw_prevalence(rollup.sufficient_stats(cells(s, d), K4, "k_hecc_cc", "n_cc"), ["grp"]),
        "country_first_group": lambda s, d: rollup.first_group(rollup.sufficient_stats(cells(s, d), K4, "k_hecc_cc", "n_cc"), "country", "grp", ["source", "grp"]),
        "value_counts_share": lambda s, d: rollup.value_share(t(s, d, "documents"), "topic"),
        "override_and_sentinel": lambda s, d: articles(s, d, "country").select("id", F.when(F.col("country") == "GB", "United Kingdom").when(F.col("country").isNull() | F.col("country").isin("", "#N/A"), "").otherwise(F.col("country")).alias("country")).groupBy("country").agg(F.count(F.lit(1)).alias("n")),
        "dimension_members": lambda s, d: rollup.members(articles(s, d, "country"), dim(s, d), "country").groupBy("country").agg(F.count(F.lit(1)).alias("n")),
        "unresolved_dimension_rows": lambda s, d: rollup.unresolved(articles(s, d, "country").where("country is not null"), dim(s, d), "country"),
        "insert_or_ignore": lambda s, d: rollup.first_writer_wins(t(s, d, "articles").where("collection_method = 'newsapi'").select("id"), t(s, d, "articles").select("id", "url", "language"), "id", ["url", "language"]),
        "resume_anti_join": lambda s, d: inference.remaining(articles(s, d), t(s, d, "classifications")),
        "lookup_default_join": lambda s, d: rollup.lookup(articles(s, d, "source_uri"), dim(s, d).where("language_code <> ''"), "source_uri", "language_code", "", "article_count").groupBy("language_code").agg(F.count(F.lit(1)).alias("n")),
        "keyword_filter": keyword_articles,
        "keyword_filter_health": lambda s, d: keyword_articles(s, d, "health"),
        "phrase_hit_counts": lambda s, d: matched(s, d).where("lang <> 'zho'").select("doc_id", F.explode(F.concat("climate", "health")).alias("h")).select("doc_id", "h.term", F.col("h.tf").cast("long").alias("tf")).dropDuplicates(),
        "substring_hit_counts": lambda s, d: matched(s, d).where("lang = 'zho'").select("doc_id", F.explode(F.concat("climate", "health")).alias("h")).select("doc_id", "h.term", F.col("h.tf").cast("long").alias("tf")).dropDuplicates(),
        "doc_lengths": lambda s, d: matched(s, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("dl").alias("total_length"), F.round(F.avg("dl"), 4).alias("avg_length")),
        "document_frequency": lambda s, d: matched(s, d).select("lang", F.explode(F.concat(*map(X.topic_terms, ("climate", "health")))).alias("h")).select("lang", "h.*").groupBy("topic", "lang", "term").agg(F.count(F.lit(1)).alias("df")),
        "language_fallback": lambda s, d: X.resolved_language(t(s, d, "documents").select("doc_id", "lang"), "lang", AVAILABLE, FALLBACK).where("resolved is not null").groupBy("lang", "resolved").agg(F.count(F.lit(1)).alias("n")),
        "bm25_scores": lambda s, d: scored(s, d).select("doc_id", "lang", *[F.round(c, 5).alias(c) for c in ("bm25_climate", "bm25_health", "bm25_avg")]),
        "score_range": lambda s, d: scored(s, d).where("bm25_avg > 0").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("bm25_avg"), 5).alias("lo"), F.round(F.avg("bm25_avg"), 5).alias("mean"), F.round(F.max("bm25_avg"), 5).alias("hi")),
        "score_thresholds": lambda s, d: articles(s, d, "content").where("length(content) > 0").agg(F.round(F.percentile(F.length("content"), 0.333), 4).alias("t1"), F.round(F.percentile(F.length("content"), 0.666), 4).alias("t2")),
        "strata_counts": lambda s, d: strata(s, d).groupBy(*STRATUM).agg(F.count(F.lit(1)).alias("n")),
        "floored_allocation": plan,
        "round_robin_sample": lambda s, d: sampling.round_robin(strata(s, d), plan(s, d), STRATUM, "country", "id", 5, 42).select("id", "country", *STRATUM),
        "stratified_split": lambda s, d: sampling.exact_split(labelled(s, d).select("id", L.combo(LABELS).alias("combo")), "id", "combo", (0.2, 0.1), 42),
        "top_sources": lambda s, d: t(s, d, "articles").where("source_uri is not null").groupBy("source_uri").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source_uri").limit(10),
        "word_budget_trim": lambda s, d: keywords.within_budget(t(s, d, "keywords"), 7).select("topic", "lang", "pos", "term"),
        "greedy_keyword_chunks": lambda s, d: keywords.chunks(t(s, d, "keywords"), 4),
        "chunk_of_pass": lambda s, d: keywords.chunks(t(s, d, "keywords"), 4).where("chunk = 2").select("topic", "lang", "pos", "term"),
        "token_budget": lambda s, d: t(s, d, "keywords").groupBy("topic", "lang").agg(F.sum(keywords.n_words(F.col("term"))).alias("n_words")),
        "dedup_keywords_ci": lambda s, d: keywords.dedup_ignoring_case(t(s, d, "keywords")),
        "flatten_alternatives": lambda s, d: t(s, d, "keywords").groupBy("topic").agg(F.sort_array(F.collect_list(F.concat(F.col("lang"), F.lit(" | "), F.col("term"), F.lit(" |  ")))).alias("xs")).select("topic", F.explode(keywords.alternatives(F.col("xs"))).alias("term")),
        "url_folder_name": lambda s, d: articles(s, d, "url").select("id", X.folder_name(F.col("url")).alias("folder")),
        "composed_ids": lambda s, d: articles(s, d, "source_uri", "published_date", "collection_method").select("id", F.concat_ws("_", F.coalesce("collection_method", F.lit("None")), F.coalesce("source_uri", F.lit("None")), F.when(F.coalesce("published_date", F.lit("")) == "", "0000").otherwise(F.substring("published_date", 1, 4)), F.format_string("%06d", F.coalesce(F.regexp_extract("id", r"(\d+)$", 1).try_cast("bigint"), F.lit(0)))).alias("new_id")),
        "truncate_text": lambda s, d: t(s, d, "documents").select("doc_id", X.truncated(F.col("text"), 500).alias("text")),
        "blank_records": lambda s, d: articles(s, d, "title", "content").where((F.coalesce(X.unicode_trim(F.col("title")), F.lit("")) == "") & (F.coalesce(X.unicode_trim(F.col("content")), F.lit("")) == "")).select("id"),
        "chat_messages": lambda s, d: articles(s, d, "title", "content").join(labelled(s, d), "id").select("id", F.to_json(L.messages("Label the article.", L.user_turn(F.col("title"), F.col("content"), 10_000), L.assistant_turn(F.lit("short"), LABELS))).alias("messages")),
        "label_combo": lambda s, d: labelled(s, d).groupBy(L.combo(LABELS).alias("combo")).agg(F.count(F.lit(1)).alias("n")),
        "parse_cot_labels": lambda s, d: cot(s, d).select("id", *[L.parsed_label(F.col("response"), c).alias(c) for c in LABELS]),
        "loose_bool": lambda s, d: t(s, d, "documents").select("doc_id", L.loose_bool(F.element_at(F.array(*map(F.lit, [" True", "no", "YES ", "0", "t", ""])), (F.col("doc_id") % 6 + 1).cast("int"))).alias("value")),
        "json_array_extract": lambda s, d: t(s, d, "keywords").select("topic", "lang", "pos", F.explode(L.json_array(F.concat(F.lit('Here: ["'), F.col("term"), F.lit('", "x"] done')))).alias("item")),
        "exact_match_rate": lambda s, d: metrics.exact_match(predicted(s, d), PAIRS),
        "binary_report": lambda s, d: metrics.binary_report(predicted(s, d), PAIRS),
        "multilabel_report": lambda s, d: metrics.multilabel_report(predicted(s, d), PAIRS | {"none": ("p_none", "t_none")}),
        "error_accounting": lambda s, d: metrics.error_accounting(cot(s, d).select(F.col("id").rlike("9$").alias("e"), *[L.parsed_label(F.col("response"), c).alias(c) for c in LABELS]), F.col("e"), LABELS),
        "label_prevalence": lambda s, d: metrics.prevalence(labelled(s, d), LABELS),
        "posterior_summary": lambda s, d: posterior.summary(draws(s, d), ["param"]),
        "posterior_percent": lambda s, d: posterior.percent_summary(draws(s, d), ["param", "grp"]),
        "posterior_contrast": lambda s, d: posterior.contrast(draws(s, d), "param", "e1", "e0", ["grp"]),
        "calendar_average": lambda s, d: posterior.average_over(draws(s, d), "level", [0, 2, 3], ["grp"]),
        "hdi_interval": lambda s, d: posterior.hdi(draws(s, d), ["param"]),
        "result_index": lambda s, d: draws(s, d).select("grp").distinct().crossJoin(dim(s, d).where("country is not null").select(F.substring("country", 1, 1).alias("time_label")).distinct()),
        "split_rhat": lambda s, d: posterior.diagnostics(draws(s, d), ["param"]),
        "worst_diagnostics": lambda s, d: posterior.worst(posterior.diagnostics(draws(s, d), ["param"])),
        "hierarchical_prevalence": lambda s, d: posterior.summary(sampler.hierarchical_prevalence(rollup.sufficient_stats(cells(s, d), K4, "k_hecc_cc", "n_cc").withColumnRenamed("grp", "group")).where("param <> 'diverging'"), ["param", "level"], digits=3),
        "hierarchical_time": lambda s, d: posterior.summary(sampler.hierarchical_prevalence(rollup.sufficient_stats(cells(s, d).withColumn("time_period", F.substring("month", 1, 4)), ["country", "grp", "time_period"], "k_hecc_cc", "n_cc").withColumnRenamed("grp", "group"), group_time=False).where("param <> 'diverging'"), ["param", "level"], digits=3),
        "classify_stub": stub_classified,
        "published_months": published_months,
    }
    return q


def _binary_sql() -> str:
    f = "CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0 END"
    return (
        LONG
        + """, c AS (SELECT label, count(*) FILTER (p AND t) AS a, count(*) FILTER (p AND NOT t) AS b, count(*) FILTER (NOT p AND t) AS c, count(*) FILTER (NOT p AND NOT t) AS d FROM long WHERE label <> 'none' GROUP BY label),
two AS (SELECT label, 'true' AS class, (a + d) / (a + b + c + d) AS acc, a AS tp, b AS fp, c AS fn FROM c UNION ALL SELECT label, 'false', (a + d) / (a + b + c + d), d, c, b FROM c),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r, tp + fn AS s FROM two),
sc AS (SELECT *, """
        + f.format(p="p", r="r")
        + """ AS f FROM pr),
av AS (SELECT label, max(acc) AS acc, avg(p) AS mp, avg(r) AS mr, avg(f) AS mf, sum(p * s) / sum(s) AS wp, sum(r * s) / sum(s) AS wr, sum(f * s) / sum(s) AS wf, CAST(sum(s) AS BIGINT) AS s FROM sc GROUP BY label)
SELECT label, class, round(p, 5) AS precision, round(r, 5) AS recall, round(f, 5) AS f1, CAST(s AS BIGINT) AS support FROM sc
UNION ALL SELECT label, 'accuracy', round(acc, 5), round(acc, 5), round(acc, 5), s FROM av UNION ALL SELECT label, 'macro', round(mp, 5), round(mr, 5), round(mf, 5), s FROM av
UNION ALL SELECT label, 'weighted', round(wp, 5), round(wr, 5), round(wf, 5), s FROM av"""
    )


def _multi_sql() -> str:
    names = [*LABELS, "none"]
    both = " + ".join(f"CAST(p_{c} AND t_{c} AS INTEGER)" for c in names)
    np_, nt = (" + ".join(f"CAST({x}_{c} AS INTEGER)" for c in names) for x in "pt")
    return (
        LONG
        + f""", c AS (SELECT label, count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND t) AS fn FROM long GROUP BY label),
u AS (SELECT label, tp, fp, fn FROM c UNION ALL SELECT 'micro avg', sum(tp), sum(fp), sum(fn) FROM c),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r, tp + fn AS s FROM u),
sc AS (SELECT label, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f, s FROM pr),
per AS (SELECT * FROM sc WHERE label <> 'micro avg'),
sm AS (SELECT {both} AS b, {np_} AS np, {nt} AS nt FROM pn)
SELECT label, round(p, 5) AS precision, round(r, 5) AS recall, round(f, 5) AS f1, CAST(s AS BIGINT) AS support FROM sc
UNION ALL SELECT 'macro avg', round(avg(p), 5), round(avg(r), 5), round(avg(f), 5), CAST(sum(s) AS BIGINT) FROM per
UNION ALL SELECT 'weighted avg', round(sum(p * s) / sum(s), 5), round(sum(r * s) / sum(s), 5), round(sum(f * s) / sum(s), 5), CAST(sum(s) AS BIGINT) FROM per
UNION ALL SELECT 'samples avg', round(avg(CASE WHEN np > 0 THEN b / np ELSE 0 END), 5), round(avg(CASE WHEN nt > 0 THEN b / nt ELSE 0 END), 5), round(avg(CASE WHEN np + nt > 0 THEN 2 * b / (np + nt) ELSE 0 END), 5), CAST(sum(nt) AS BIGINT) FROM sm"""
    )


def _keyword_sql(topic: str) -> str:
    names = ", ".join(f"('{n}', '{c}')" for n, c in X.LANGUAGE_CODES.items())
    return rf"""WITH names(name, code) AS (VALUES {names}),
a AS (SELECT DISTINCT id, coalesce(title, '') || ' ' || coalesce(content, '') AS text, coalesce(code, language) AS lang FROM articles LEFT JOIN names ON name = language WHERE content <> ''),
k AS (SELECT DISTINCT lang, lower(term) AS term FROM keywords WHERE topic = '{topic}' AND term IS NOT NULL),
united AS (SELECT lang, term FROM k UNION SELECT l.lang, k.term FROM (SELECT DISTINCT lang FROM k) l, k WHERE k.lang = 'eng'),
p AS (SELECT lang, '(?i)(^|[^\p{{L}}\p{{N}}_])(' || string_agg(term, '|') || ')($|[^\p{{L}}\p{{N}}_])' AS p FROM united GROUP BY lang)
SELECT id FROM a JOIN p ON p.lang = CASE WHEN a.lang IN (SELECT lang FROM k) THEN a.lang ELSE 'eng' END WHERE p.lang <> 'zho' AND regexp_matches(text, p)
UNION ALL SELECT id FROM a WHERE lang = 'zho' AND EXISTS (SELECT 1 FROM united b WHERE b.lang = 'zho' AND contains(lower(a.text), b.term))"""


BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def oracle_sql() -> dict[str, str]:
    w = "WITH "
    lab = ", ".join(LABELS)
    return {
        "monthly_cell_rollup": w + CELLS + " SELECT * FROM cells",
        "sufficient_stats_yearly": w + CELLS + " SELECT source, country, grp, substr(month, 1, 4) AS year, CAST(sum(k_hecc_cc) AS BIGINT) AS k, CAST(sum(n_cc) AS BIGINT) AS n FROM cells GROUP BY ALL HAVING sum(n_cc) > 0",
        "sufficient_stats_monthly": w + CELLS + " SELECT source, country, grp, month, CAST(sum(k_hecc_cc) AS BIGINT) AS k, CAST(sum(n_cc) AS BIGINT) AS n FROM cells GROUP BY ALL HAVING sum(n_cc) > 0",
        "sufficient_stats_no_time": w + CELLS + " SELECT source, country, grp, CAST(sum(k_health_cc) AS BIGINT) AS k, CAST(sum(n_cc) AS BIGINT) AS n FROM cells GROUP BY ALL HAVING sum(n_cc) > 0",
        "stats_from_rows": w + FACTS + " SELECT source, country, grp, count(*) FILTER (health) AS k, count(health) AS n FROM facts WHERE cc GROUP BY ALL HAVING count(health) > 0",
        "global_monthly_counts": w + FACTS + " SELECT month || '-01' AS month, count(*) AS n_cc, count(*) FILTER (health) AS n_cc_health, count(*) FILTER (hecc) AS n_cc_hecc FROM facts WHERE cc GROUP BY ALL",
        "monthly_shares": w + FACTS + ", g AS (SELECT month || '-01' AS month, round(100.0 * count(*) FILTER (health) / count(*), 4) AS a, round(100.0 * count(*) FILTER (hecc) / count(*), 4) AS b FROM facts WHERE cc GROUP BY ALL) SELECT month, a AS pct_health, b AS pct_hecc, round(a - b, 4) AS difference FROM g",
        "period_labels": "SELECT strftime(o_orderdate, '%Y') AS yearly, strftime(o_orderdate, '%Y') || 'Q' || quarter(o_orderdate) AS quarterly, strftime(o_orderdate, '%Y-%m') AS monthly, count(*) AS n FROM orders GROUP BY ALL",
        "min_volume_filter": "SELECT source_uri, count(*) AS n FROM articles WHERE source_uri IS NOT NULL GROUP BY ALL HAVING count(*) >= 30",
        "any_label_selection": w + LABELLED + f", a AS (SELECT DISTINCT id, published_date, language FROM articles) SELECT a.id, language, {lab} FROM a JOIN labelled l ON a.id = l.id WHERE ({' OR '.join(f'coalesce({c}, false)' for c in LABELS)}) AND substr(published_date, 1, 4) IN ('2021', '2022', '2023', '2024', '2025')",
        "modal_country_per_source": "WITH c AS (SELECT source_uri, country, count(*) AS n FROM articles WHERE source_uri <> '' AND country <> '' GROUP BY ALL) SELECT source_uri, min(country) AS country, max(n) AS n FROM c WHERE n = (SELECT max(n) FROM c b WHERE b.source_uri = c.source_uri) GROUP BY source_uri",
        "dense_level_index": "SELECT country, CAST(dense_rank() OVER (ORDER BY country) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT country FROM source_languages WHERE country IS NOT NULL)",
        "raw_prevalence": w + CELLS + " SELECT grp, round(sum(k_hecc_cc) / sum(n_cc), 6) AS prevalence FROM cells GROUP BY grp",
        "country_first_group": w + CELLS + " SELECT country, arg_min(grp, source) AS grp FROM cells WHERE n_cc > 0 GROUP BY country",
        "value_counts_share": "SELECT topic, count(*) AS n, round(100.0 * count(*) / (SELECT count(topic) FROM documents), 4) AS pct FROM documents WHERE topic IS NOT NULL GROUP BY topic",
        "override_and_sentinel": "SELECT CASE WHEN country = 'GB' THEN 'United Kingdom' WHEN country IS NULL OR country IN ('', '#N/A') THEN '' ELSE country END AS country, count(DISTINCT id) AS n FROM articles GROUP BY 1",
        "dimension_members": "SELECT country, count(DISTINCT id) AS n FROM articles WHERE country IN (SELECT country FROM source_languages) GROUP BY country",
        "unresolved_dimension_rows": "SELECT country, count(DISTINCT id) AS n FROM articles WHERE country IS NOT NULL AND country NOT IN (SELECT country FROM source_languages WHERE country IS NOT NULL) GROUP BY country",
        "insert_or_ignore": "SELECT DISTINCT id, url, language FROM articles WHERE id NOT IN (SELECT id FROM articles WHERE collection_method = 'newsapi')",
        "resume_anti_join": "SELECT DISTINCT id FROM articles WHERE id NOT IN (SELECT id FROM classifications WHERE id IS NOT NULL)",
        "lookup_default_join": "SELECT coalesce(language_code, '') AS language_code, count(DISTINCT id) AS n FROM articles LEFT JOIN (SELECT source_uri AS u, arg_max(language_code, article_count) AS language_code FROM source_languages WHERE language_code <> '' GROUP BY 1) ON source_uri = u GROUP BY 1",
        "keyword_filter": _keyword_sql("climate"),
        "keyword_filter_health": _keyword_sql("health"),
        "phrase_hit_counts": w + HITS + " SELECT DISTINCT doc_id, term, tf FROM hits WHERE tf > 0 AND lang <> 'zho'",
        "substring_hit_counts": w + HITS + " SELECT DISTINCT doc_id, term, tf FROM hits WHERE tf > 0 AND lang = 'zho'",
        "doc_lengths": w + HITS + " SELECT lang, count(*) AS n_docs, CAST(sum(dl) AS BIGINT) AS total_length, round(avg(dl), 4) AS avg_length FROM lengths GROUP BY lang",
        "document_frequency": w + HITS + " SELECT topic, lang, term, count(*) AS df FROM hits WHERE tf > 0 GROUP BY ALL",
        "language_fallback": "WITH d AS (SELECT lang, " + RESOLVED + " AS resolved FROM documents) SELECT lang, resolved, count(*) AS n FROM d WHERE resolved IS NOT NULL GROUP BY ALL",
        "bm25_scores": w + BM25 + " SELECT doc_id, lang, round(c, 5) AS bm25_climate, round(h, 5) AS bm25_health, round((c + h) / 2, 5) AS bm25_avg FROM bm",
        "score_range": w + BM25 + " SELECT count(*) AS n, round(min((c + h) / 2), 5) AS lo, round(avg((c + h) / 2), 5) AS mean, round(max((c + h) / 2), 5) AS hi FROM bm WHERE c + h > 0",
        "score_thresholds": "SELECT round(quantile_cont(n, 0.333), 4) AS t1, round(quantile_cont(n, 0.666), 4) AS t2 FROM (SELECT DISTINCT id, CAST(length(content) AS DOUBLE) AS n FROM articles WHERE length(content) > 0)",
        "strata_counts": w + STRATA + " SELECT lang_group, year, size_bin, size AS n FROM strata",
        "floored_allocation": w + ALLOCATION + " SELECT * FROM plan",
        "round_robin_sample": w + ALLOCATION + """, h AS (SELECT r.*, n_sample, md5('42/' || id) AS hh, md5('42/' || country || '/' || r.lang_group || '/' || r.year || '/' || r.size_bin) AS ch FROM rows r JOIN plan p USING (lang_group, year, size_bin)),
i AS (SELECT *, row_number() OVER (PARTITION BY lang_group, year, size_bin, country ORDER BY hh, id) - 1 AS i, dense_rank() OVER (PARTITION BY lang_group, year, size_bin ORDER BY ch, country) AS c FROM h),
k AS (SELECT *, row_number() OVER (PARTITION BY lang_group, year, size_bin ORDER BY i >= 5, CASE WHEN i < 5 THEN i ELSE c END, CASE WHEN i < 5 THEN c ELSE i END) AS k FROM i)
SELECT id, country, lang_group, year, size_bin FROM k WHERE k <= n_sample""",
        "stratified_split": w + LABELLED + ", c AS (SELECT id, concat_ws('-', " + ", ".join(f"CASE WHEN coalesce({c}, false) THEN 'T' ELSE 'F' END" for c in LABELS) + """) AS combo FROM labelled),
g AS (SELECT combo, count(*) AS n FROM c GROUP BY combo),
t1 AS (SELECT combo, n, n * t / total AS x, t FROM g, (SELECT sum(n) AS total, ceil(sum(n) / 5.0) AS t FROM g)),
t2 AS (SELECT combo, n, t, floor(x) AS f, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, combo) AS r FROM t1),
t3 AS (SELECT combo, n, f + CASE WHEN r <= t - (SELECT sum(f) FROM t2) THEN 1 ELSE 0 END AS te FROM t2),
v1 AS (SELECT combo, te, n - te AS m, (n - te) * t / total AS x, t FROM t3, (SELECT sum(n - te) AS total, ceil(sum(n - te) / 10.0) AS t FROM t3)),
v2 AS (SELECT combo, te, t, floor(x) AS f, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, combo) AS r FROM v1),
v3 AS (SELECT combo, te, f + CASE WHEN r <= t - (SELECT sum(f) FROM v2) THEN 1 ELSE 0 END AS va FROM v2),
k AS (SELECT id, combo, row_number() OVER (PARTITION BY combo ORDER BY md5('42/' || id), id) AS k FROM c)
SELECT id, combo, CASE WHEN k <= te THEN 'test' WHEN k <= te + va THEN 'validation' ELSE 'train' END AS split FROM k JOIN v3 USING (combo)""",
        "top_sources": "SELECT source_uri, count(*) AS n FROM articles WHERE source_uri IS NOT NULL GROUP BY 1 ORDER BY n DESC, source_uri LIMIT 10",
        "word_budget_trim": r"SELECT topic, lang, pos, term FROM (SELECT *, sum(len(string_split(term, ' '))) OVER (PARTITION BY topic, lang ORDER BY pos) AS c FROM keywords) WHERE c <= 7",
        "greedy_keyword_chunks": GREEDY + " SELECT topic, lang, pos, term, chunk FROM walk",
        "chunk_of_pass": GREEDY + " SELECT topic, lang, pos, term FROM walk WHERE chunk = 2",
        "token_budget": "SELECT topic, lang, CAST(sum(len(string_split(term, ' '))) AS BIGINT) AS n_words FROM keywords GROUP BY ALL",
        "dedup_keywords_ci": "SELECT topic, lang, pos, term FROM (SELECT *, row_number() OVER (PARTITION BY topic, lang, lower(term) ORDER BY pos) AS r FROM keywords) WHERE r = 1",
        "flatten_alternatives": "SELECT topic, lang AS term FROM keywords UNION SELECT topic, term FROM keywords",
        "url_folder_name": r"SELECT DISTINCT id, CASE WHEN url IS NULL THEN NULL ELSE replace(regexp_replace(lower(regexp_extract(regexp_replace(trim(url), '/+$', ''), '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#]*@)?([^/?#:]*)', 1)), '^www\.', ''), '.', '_') END AS folder FROM articles",
        "composed_ids": r"SELECT DISTINCT id, concat_ws('_', coalesce(collection_method, 'None'), coalesce(source_uri, 'None'), CASE WHEN coalesce(published_date, '') = '' THEN '0000' ELSE substr(published_date, 1, 4) END, printf('%06d', CAST(regexp_extract(id, '(\d+)$', 1) AS BIGINT))) AS new_id FROM articles",
        "truncate_text": "SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END AS text FROM documents",
        "blank_records": r"SELECT DISTINCT id FROM articles WHERE regexp_full_match(coalesce(title, ''), '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*') AND regexp_full_match(coalesce(content, ''), '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*')",
        "label_combo": w + LABELLED + " SELECT concat_ws('-', " + ", ".join(f"CASE WHEN coalesce({c}, false) THEN 'T' ELSE 'F' END" for c in LABELS) + ") AS combo, count(*) AS n FROM labelled GROUP BY 1",
        "parse_cot_labels": w + LABELLED + " SELECT id, " + ", ".join(f"CASE WHEN substr(md5(id), 1, 1) <> 'a' THEN coalesce({c}, false) END AS {c}" for c in LABELS) + " FROM labelled",
        "loose_bool": "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false END AS value FROM documents",
        "json_array_extract": "SELECT topic, lang, pos, unnest([term, 'x']) AS item FROM keywords",
        "exact_match_rate": w + PREDICTED + ", m AS (SELECT count(*) AS n, count(*) FILTER (" + " AND ".join(f"p_{c} = t_{c}" for c in LABELS) + ") AS n_exact FROM predicted) SELECT n, n_exact, round(n_exact / n, 6) AS rate FROM m",
        "binary_report": w + _binary_sql(),
        "multilabel_report": w + _multi_sql(),
        "error_accounting": w + LABELLED + " SELECT count(*) AS n, count(*) FILTER (id LIKE '%9') AS n_errors, count(*) FILTER (id NOT LIKE '%9' AND substr(md5(id), 1, 1) = 'a') AS n_unparsed, count(*) FILTER (id NOT LIKE '%9' AND substr(md5(id), 1, 1) <> 'a') AS n_parsed FROM labelled",
        "label_prevalence": w + LABELLED + " " + " UNION ALL ".join(f"SELECT '{c}' AS label, round(100 * avg(CAST(coalesce({c}, false) AS INTEGER)), 4) AS pct FROM labelled" for c in LABELS),
        "posterior_summary": w + DRAWS + ", " + summary_sql("draws", "param"),
        "posterior_percent": w + DRAWS + " SELECT param, grp, count(*) AS n, round_even(quantile_cont(value * 100, 0.5), 1) + 0.0 AS median, round_even(quantile_cont(value * 100, 0.025), 1) + 0.0 AS eti_low, round_even(quantile_cont(value * 100, 0.975), 1) + 0.0 AS eti_high FROM draws GROUP BY ALL",
        "posterior_contrast": w + DRAWS + ", o AS (SELECT a.grp, a.value - b.value AS value FROM draws a JOIN draws b ON a.grp = b.grp AND a.chain = b.chain AND a.draw = b.draw WHERE a.param = 'e1' AND b.param = 'e0'), " + summary_sql("o", "grp"),
        "calendar_average": w + DRAWS + ", o AS (SELECT grp, chain, draw, avg(value) AS value FROM draws WHERE level IN (0, 2, 3) GROUP BY ALL), " + summary_sql("o", "grp"),
        "hdi_interval": w + DRAWS + """, r AS (SELECT *, row_number() OVER (PARTITION BY param ORDER BY value, chain, draw) AS i, count(*) OVER (PARTITION BY param) AS n FROM draws),
b AS (SELECT x.param, x.value AS low, y.value AS high, row_number() OVER (PARTITION BY x.param ORDER BY y.value - x.value, x.value) AS k FROM r x JOIN r y ON x.param = y.param AND y.i = x.i + CAST(floor(x.n * 0.95::DOUBLE) AS BIGINT)),
m AS (SELECT param, avg(value) AS mean, stddev(value) AS sd FROM draws GROUP BY param) SELECT b.param, round(mean, 6) AS mean, round(sd, 6) AS sd, round(low, 6) AS hdi_low, round(high, 6) AS hdi_high FROM b JOIN m ON b.param = m.param WHERE k = 1""",
        "result_index": "SELECT grp, time_label FROM (SELECT DISTINCT 'g' || label AS grp FROM embeddings), (SELECT DISTINCT substr(country, 1, 1) AS time_label FROM source_languages WHERE country IS NOT NULL)",
        "master_cube": w + COVARIATES + """, x AS (SELECT source AS source_uri, CASE WHEN country = 'GB' THEN 'United Kingdom' ELSE country END AS country, strftime(published_at, '%Y-%m') AS month, topic FROM documents)
SELECT source_uri, country, iso3, month, lc_region, who_region, hdi_2025, count(*) AS n_total, count(*) FILTER (topic IN ('climate', 'both')) AS n_cc, count(*) FILTER (topic = 'both') AS k_hecc_cc, count(*) FILTER (topic = 'both') AS k_health_cc
FROM x JOIN cov USING (country) WHERE source_uri IS NOT NULL AND month BETWEEN '2021-01' AND '2025-12' GROUP BY ALL ORDER BY country, source_uri, month""",
        "country_covariates": w + COVARIATES + " SELECT * FROM cov",
        "score_update": w + hits_sql(RESOLVED, "'eng', 'spa', 'deu', 'fra'") + SCORED + " SELECT d.doc_id, d.lang, round(c, 5) AS bm25_climate, round(h, 5) AS bm25_health, round((c + h) / 2, 5) AS bm25_avg FROM documents d LEFT JOIN bm ON bm.doc_id = d.doc_id",
        "united_keywords": """WITH u AS (SELECT topic, lang, term, 1 AS own, pos FROM keywords WHERE lang <> 'eng' AND term IS NOT NULL UNION ALL
  SELECT e.topic, l.lang, e.term, 0, e.pos FROM keywords e JOIN (SELECT DISTINCT topic, lang FROM keywords) l ON e.topic = l.topic WHERE e.lang = 'eng' AND e.term IS NOT NULL),
f AS (SELECT topic, lang, arg_min(term, own * 100000 + pos) AS term, min(own * 100000 + pos) AS at FROM u GROUP BY topic, lang, lower(term))
SELECT topic, lang, CAST((SELECT count(*) FROM f g WHERE g.topic = f.topic AND g.lang = f.lang AND g.at < f.at) AS INTEGER) AS pos, term FROM f""",
        "annotation_join": w + ANNOTATIONS + " SELECT DISTINCT a.id, " + ", ".join(f"CAST({c} AS BOOLEAN) AS {c}" for c in LABELS) + " FROM articles a JOIN (SELECT * FROM ann WHERE " + " AND ".join(f"{c} <> '-'" for c in LABELS) + ") USING (id)",
        "annotation_counters": w + ANNOTATIONS + ", a AS (SELECT DISTINCT id FROM articles), j AS (SELECT ann.id IS NULL AS none, " + " OR ".join(f"{c} = '-'" for c in LABELS) + " AS lacks FROM a LEFT JOIN ann USING (id)) SELECT count(*) AS n, count(*) FILTER (NOT none AND NOT lacks) AS n_used, count(*) FILTER (none) AS n_no_match, count(*) FILTER (NOT none AND lacks) AS n_missing FROM j",
        "chat_turns": w + ANNOTATIONS + ", b AS (SELECT DISTINCT id, regexp_replace(regexp_replace(coalesce(title, '') || chr(10) || chr(10) || coalesce(content, ''), '^" + BLANK + "+', ''), '" + BLANK + "+$', '') AS body FROM articles) SELECT id, '### Article:' || chr(10) || CASE WHEN length(body) > 10000 THEN left(body, 10000) || '...' ELSE body END AS user_text, '<think>' || chr(10) || 'short' || chr(10) || '</think>' || chr(10) || chr(10) || '```yaml' || chr(10) || " + " || ".join(f"'{c}:' || chr(10) || '  label: ' || {c} || chr(10)" for c in LABELS) + " || '```' AS assistant_text FROM b JOIN ann USING (id) WHERE " + " AND ".join(f"{c} <> '-'" for c in LABELS),
        "chat_messages": w + LABELLED + ", b AS (SELECT DISTINCT id, regexp_replace(regexp_replace(coalesce(title, '') || chr(10) || chr(10) || coalesce(content, ''), '^" + BLANK + "+', ''), '" + BLANK + "+$', '') AS body FROM articles), t AS (SELECT id, '### Article:' || chr(10) || CASE WHEN length(body) > 10000 THEN left(body, 10000) || '...' ELSE body END AS u, '<think>' || chr(10) || 'short' || chr(10) || '</think>' || chr(10) || chr(10) || '```yaml' || chr(10) || " + " || ".join(f"'{c}:' || chr(10) || '  label: ' || coalesce({c}, false) || chr(10)" for c in LABELS) + " || '```' AS a FROM b JOIN labelled USING (id)) SELECT id, CAST(to_json([struct_pack(role := 'system', content := 'Label the article.'), struct_pack(role := 'user', content := u), struct_pack(role := 'assistant', content := a)]) AS VARCHAR) AS messages FROM t",
        "classify_stub": "SELECT doc_id AS id, " + ", ".join("(" + " OR ".join(f"contains(lower(text), '{x}')" for x in xs) + f") AS {c}" for c, xs in STUB.items()) + ", CAST(NULL AS VARCHAR) AS error FROM documents WHERE text IS NOT NULL",
        "combo_from_text": w + ANNOTATIONS + " SELECT " + " || '-' || ".join(f"CASE {c} WHEN 'true' THEN 'T' ELSE 'F' END" for c in LABELS) + " AS combo, count(DISTINCT id) AS n FROM ann WHERE id IN (SELECT id FROM articles) AND " + " AND ".join(f"{c} <> '-'" for c in LABELS) + " GROUP BY 1",
        "optional_predicates": "SELECT collection_method, count(DISTINCT id) AS n FROM articles WHERE language = 'eng' AND (source_uri IS NULL OR source_uri <> 'gulquidaily.test') GROUP BY 1",
        "distinct_counts": "SELECT source_uri, count(DISTINCT id) AS n_id, count(DISTINCT country) AS n_country, count(DISTINCT language) AS n_language FROM articles GROUP BY 1",
        "language_codes": "SELECT CASE language " + " ".join(f"WHEN '{n}' THEN '{c}'" for n, c in X.LANGUAGE_CODES.items()) + " ELSE '' END AS code, count(*) AS n FROM (SELECT DISTINCT id, language FROM articles) GROUP BY 1",
        "structured_labels": w + LABELLED + f" SELECT id, {LABELS[0]}, {LABELS[1]}, CAST(NULL AS BOOLEAN) AS {LABELS[2]}, CAST(NULL AS BOOLEAN) AS {LABELS[3]} FROM labelled",
        "nested_values": "SELECT source_uri, coalesce(language_code, '') AS code, 'none' AS other FROM source_languages",
        "capped_resume": "SELECT DISTINCT id FROM articles WHERE id NOT IN (SELECT id FROM classifications WHERE id IS NOT NULL) ORDER BY id LIMIT 7",
        "dry_run": "WITH a AS (SELECT DISTINCT id FROM articles), c AS (SELECT DISTINCT id FROM classifications) SELECT count(*) AS n, count(c.id) AS n_done, count(*) - count(c.id) AS n_to_do FROM a LEFT JOIN c USING (id)",
        "run_matrix": "SELECT * FROM (VALUES ('k_hecc_cc', 'region', 'yearly', false, true, false), ('k_hecc_cc', 'climate_zone', 'monthly', true, false, false), ('k_hecc_cc', 'hdi_category', NULL, true, true, true), ('k_health_cc', 'region', 'yearly', false, true, false)) v(outcome, \"group\", time, group_time, global_time, independent)",
        "score_bins": """WITH a AS (SELECT DISTINCT id, language, length(content) AS n, content FROM articles WHERE length(content) > 0), q AS (SELECT quantile_cont(CAST(n AS DOUBLE), 0.333) AS t1, quantile_cont(CAST(n AS DOUBLE), 0.666) AS t2 FROM a),
top AS (SELECT language FROM a WHERE language IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, language LIMIT 10)
SELECT CASE WHEN language IN (SELECT language FROM top) THEN language ELSE 'other' END AS lang_group, CASE WHEN n < t1 THEN 'low' WHEN n < t2 THEN 'medium' ELSE 'high' END AS size_bin, count(*) AS n FROM a, q GROUP BY ALL""",
        "first_sources": "SELECT source_uri, count(*) AS n FROM articles WHERE source_uri IN (SELECT DISTINCT source_uri FROM articles WHERE source_uri <> 'babre-courier.invalid' ORDER BY 1 LIMIT 5) GROUP BY 1",
        "stats_by_period": w + FACTS + " SELECT source, country, grp, substr(month, 1, 4) || 'Q' || CAST((CAST(substr(month, 6, 2) AS INTEGER) + 2) // 3 AS VARCHAR) AS time_period, count(*) FILTER (health) AS k, count(health) AS n FROM facts WHERE cc GROUP BY ALL HAVING count(health) > 0",
        "posterior_extremes": w + DRAWS + ", m AS (SELECT param, round(quantile_cont(value, 0.5), 6) AS median FROM draws GROUP BY param) (SELECT 'top' AS side, param, median FROM m ORDER BY median DESC, param LIMIT 5) UNION ALL (SELECT 'bottom', param, median FROM m ORDER BY median, param LIMIT 5)",
        "windowed_counts": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL",
        "current_time": "SELECT strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS at FROM events",
    }


GREEDY = """WITH RECURSIVE k AS (SELECT *, row_number() OVER (PARTITION BY topic, lang ORDER BY pos) AS i, CAST(len(string_split(term, ' ')) AS INTEGER) AS w FROM keywords),
walk AS (SELECT topic, lang, pos, term, i, w AS used, 1 AS chunk FROM k WHERE i = 1
  UNION ALL SELECT k.topic, k.lang, k.pos, k.term, k.i, CASE WHEN used + k.w <= 4 THEN used + k.w ELSE k.w END, CASE WHEN used + k.w <= 4 THEN chunk ELSE chunk + 1 END
  FROM walk JOIN k ON k.topic = walk.topic AND k.lang = walk.lang AND k.i = walk.i + 1)"""
