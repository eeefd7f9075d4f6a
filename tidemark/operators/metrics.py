"""Reports over label tables: one pass of conditional counts, then arithmetic on a handful of numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _n(c: Column) -> Column:
    return F.sum(F.coalesce(c, F.lit(False)).cast("long"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def exact_match(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    same = reduce(lambda a, b: a & b, [F.col(p) == F.col(t) for p, t in pairs.values()])
    return df.agg(F.count(F.lit(1)).alias("n"), _n(same).alias("n_exact")).withColumn("rate", F.round(_ratio(F.col("n_exact"), F.col("n")), 6))


def _long(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.col(p).alias("p"), F.col(t).alias("t")) for k, (p, t) in pairs.items()]))
    return df.select(rows.alias("r")).select("r.*")


def _scores(df: DataFrame) -> DataFrame:
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    df = df.withColumns({"__p": p, "__r": r}).withColumn("__f", _ratio(2 * F.col("__p") * F.col("__r"), F.col("__p") + F.col("__r")))
    return df


def binary_report(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """(label, class, precision, recall, f1, support) for both classes of each label, and its accuracy, macro and weighted averages."""
    c = _long(df, pairs).groupBy("label").agg(_n(F.col("p") & F.col("t")).alias("a"), _n(F.col("p") & ~F.col("t")).alias("b"), _n(~F.col("p") & F.col("t")).alias("c"), _n(~F.col("p") & ~F.col("t")).alias("d"))
    side = F.explode(F.array(
        F.struct(F.lit("true").alias("class"), F.col("a").alias("tp"), F.col("b").alias("fp"), F.col("c").alias("fn")),
        F.struct(F.lit("false").alias("class"), F.col("d").alias("tp"), F.col("c").alias("fp"), F.col("b").alias("fn")),
    ))
    two = _scores(c.select("label", ((F.col("a") + F.col("d")) / (F.col("a") + F.col("b") + F.col("c") + F.col("d"))).alias("acc"), side.alias("s")).select("label", "acc", "s.*"))
    two = two.withColumn("support", F.col("tp") + F.col("fn"))
    w = F.sum("support").cast("double")
    avg = two.groupBy("label").agg(
        F.first("acc").alias("acc"), F.avg("__p").alias("mp"), F.avg("__r").alias("mr"), F.avg("__f").alias("mf"),
        *[(F.sum(F.col(x) * F.col("support")) / w).alias(y) for x, y in (("__p", "wp"), ("__r", "wr"), ("__f", "wf"))], F.sum("support").alias("support"),
    )
    more = F.explode(F.array(*[F.struct(F.lit(n).alias("class"), F.col(a).alias("p"), F.col(b).alias("r"), F.col(f).alias("f")) for n, a, b, f in (("accuracy", "acc", "acc", "acc"), ("macro", "mp", "mr", "mf"), ("weighted", "wp", "wr", "wf"))]))
    rows = two.select("label", "class", F.col("__p").alias("p"), F.col("__r").alias("r"), F.col("__f").alias("f"), "support")
    rows = rows.unionByName(avg.select("label", "support", more.alias("m")).select("label", "m.*", "support"))
    return rows.select("label", "class", F.round("p", 5).alias("precision"), F.round("r", 5).alias("recall"), F.round("f", 5).alias("f1"), "support")


def multilabel_report(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """(label, precision, recall, f1, support) per label, and micro, macro, weighted and samples averages: one pass of sums, then arithmetic on one row."""
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    both = sum((one(F.col(p) & F.col(t)) for p, t in pairs.values()), F.lit(0))
    np_, nt = sum((one(F.col(p)) for p, _ in pairs.values()), F.lit(0)), sum((one(F.col(t)) for _, t in pairs.values()), F.lit(0))
    sums = []
    for i, (p, t) in enumerate(pairs.values()):
        p, t = F.col(p), F.col(t)
        sums += [_n(p & t).alias(f"tp{i}"), _n(p & ~t).alias(f"fp{i}"), _n(~p & t).alias(f"fn{i}")]
    mean = [F.coalesce(F.avg(c), F.lit(0.0)).alias(k) for k, c in (("sp", _ratio(both, np_)), ("sr", _ratio(both, nt)), ("sf", _ratio(2 * both, np_ + nt)))]
    row = df.agg(*[F.coalesce(c, F.lit(0)).alias(f"c{k}") for k, c in enumerate(sums)], *mean, F.coalesce(F.sum(nt), F.lit(0)).cast("long").alias("sn"))

    def scored(label: str, tp: Column, fp: Column, fn: Column) -> Column:
        p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
        return F.struct(F.lit(label).alias("label"), p.alias("p"), r.alias("r"), _ratio(2 * p * r, p + r).alias("f"), (tp + fn).cast("long").alias("support"))

    at = lambda i: [F.col(f"c{3 * i + k}") for k in range(3)]
    per = [scored(label, *at(i)) for i, label in enumerate(pairs)]
    micro = scored("micro avg", *[reduce(lambda a, b: a + b, [at(i)[k] for i in range(len(pairs))]) for k in range(3)])
    row = row.select("*", F.array(*per).alias("per"), micro.alias("micro"))
    fields = ("p", "r", "f")
    total = lambda fn: F.aggregate("per", F.lit(0.0), lambda s, x: s + fn(x))
    support = F.col("micro.support")
    macro = F.struct(F.lit("macro avg").alias("label"), *[(total(lambda x, c=c: x[c]) / F.lit(len(pairs))).alias(c) for c in fields], support.alias("support"))
    weighted = F.struct(F.lit("weighted avg").alias("label"), *[_ratio(total(lambda x, c=c: x[c] * x["support"]), support).alias(c) for c in fields], support.alias("support"))
    samples = F.struct(F.lit("samples avg").alias("label"), F.col("sp").alias("p"), F.col("sr").alias("r"), F.col("sf").alias("f"), F.col("sn").alias("support"))
    rows = row.select(F.explode(F.concat("per", F.array("micro", macro, weighted, samples))).alias("x")).select("x.*")
    return rows.select("label", F.round("p", 5).alias("precision"), F.round("r", 5).alias("recall"), F.round("f", 5).alias("f1"), "support")


def error_accounting(df: DataFrame, error: Column, parsed: list[str]) -> DataFrame:
    """Rows, rows whose call failed, and rows of the others whose answer lacks a label."""
    lacks = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in parsed])
    return df.agg(F.count(F.lit(1)).alias("n"), _n(error).alias("n_errors"), _n(~error & lacks).alias("n_unparsed"), _n(~error & ~lacks).alias("n_parsed"))


def prevalence(df: DataFrame, labels: list[str]) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.coalesce(F.col(c), F.lit(False)).alias("v")) for c in labels]))
    return df.select(rows.alias("r")).groupBy("r.label").agg(F.round(100 * F.avg(F.col("r.v").cast("int")), 4).alias("pct"))
