"""Keyword dictionaries: flattening, de-duplication, budgets and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def term_lists(keywords: DataFrame, topic: str) -> dict[str, list[str]]:
    """lang -> terms in order, for building patterns. A dictionary is a small configuration table."""
    rows = keywords.where((F.col("topic") == topic) & F.col("term").isNotNull()).orderBy("lang", "pos").collect()
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r.lang, []).append(r.term)
    return out


def with_english(keywords: DataFrame, english: str = "eng") -> DataFrame:
    """(topic, lang, pos, term): for each language the English terms, then its own, the first spelling of each term ignoring case.

    English keeps its own list. Positions count from 0 in the united list. Terms that are null are left out.
    """
    k = keywords.where("topic is not null and lang is not null and term is not null").select("topic", "lang", "pos", "term")
    langs = k.select("topic", "lang").distinct()
    eng = k.where(F.col("lang") == english).select("topic", F.lit(0).alias("own"), "pos", "term").join(langs, "topic")
    own = k.where(F.col("lang") != english).select("topic", F.lit(1).alias("own"), "pos", "term", "lang")
    # windows over one dictionary's terms
    first = F.row_number().over(Window.partitionBy("topic", "lang", F.lower("term")).orderBy("own", "pos"))
    place = F.row_number().over(Window.partitionBy("topic", "lang").orderBy("own", "pos"))
    both = eng.unionByName(own).withColumn("__r", first).where("__r = 1")
    return both.select("topic", "lang", (place - 1).cast("int").alias("pos"), "term")


def dedup_ignoring_case(keywords: DataFrame) -> DataFrame:
    """First spelling of each term per topic and language."""
    w = Window.partitionBy("topic", "lang", F.lower("term")).orderBy("pos")
    return keywords.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def n_words(term: Column) -> Column:
    return F.size(F.filter(F.split(term, r"\s+"), lambda x: x != ""))


def within_budget(keywords: DataFrame, limit: int) -> DataFrame:
    """Leading terms of each list whose words together stay within ``limit``."""
    w = Window.partitionBy("topic", "lang").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return keywords.withColumn("words_so_far", F.sum(n_words(F.col("term"))).over(w)).where(F.col("words_so_far") <= limit)


def chunks(keywords: DataFrame, limit: int) -> DataFrame:
    """(topic, lang, pos, term, chunk): terms packed in order into chunks of at most ``limit`` words; a longer term stands alone."""
    lists = keywords.groupBy("topic", "lang").agg(F.sort_array(F.collect_list(F.struct("pos", "term", n_words(F.col("term")).alias("w")))).alias("ts"))
    start = F.struct(F.lit(1).alias("c"), F.lit(0).alias("w"), F.array().cast("array<struct<pos:int,term:string,chunk:int>>").alias("out"))

    def add(s, t):
        fits = (s["w"] + t["w"] <= limit) | (s["w"] == 0)
        c = F.when(fits, s["c"]).otherwise(s["c"] + 1)
        w = F.when(fits, s["w"] + t["w"]).otherwise(t["w"])
        return F.struct(c.alias("c"), w.alias("w"), F.concat(s["out"], F.array(F.struct(t["pos"].alias("pos"), t["term"].alias("term"), c.alias("chunk")))).alias("out"))

    packed = lists.select("topic", "lang", F.aggregate("ts", start, add).alias("s"))
    return packed.select("topic", "lang", F.explode("s.out").alias("t")).select("topic", "lang", "t.*")


def alternatives(c: Column) -> Column:
    """Texts with ``" | "`` between alternatives, as one list of distinct trimmed texts in order."""
    flat = F.flatten(F.transform(c, lambda x: F.split(x, r" \| ")))
    return F.array_distinct(F.filter(F.transform(flat, lambda x: F.trim(x)), lambda x: x != ""))


def to_nested(keywords: DataFrame) -> DataFrame:
    """One row with the dictionary as JSON: topic -> language -> terms."""
    per = keywords.groupBy("topic", "lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("terms"))
    per = per.groupBy("topic").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("lang", "terms")))).alias("m"))
    return per.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("topic", "m")))).alias("json"))
