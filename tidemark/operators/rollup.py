"""Cells, sufficient statistics and the small aggregates around them.

Grouping keys that are null never form a group (``keyed``); conditional counts are map-side combinable sums, so every
rollup is one exchange of at most one row per task and key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keyed(df: DataFrame, keys: list[str], blank_too: bool = False) -> DataFrame:
    """Rows whose keys are all present (``blank_too``: and not the empty string)."""
    for k in keys:
        df = df.where(F.col(k).isNotNull() & ((F.col(k).cast("string") != "") if blank_too else F.lit(True)))
    return df


def flag(c: Column, missing_is_true: bool = False) -> Column:
    """Two-valued boolean of a three-valued one."""
    return F.coalesce(c, F.lit(missing_is_true))


def count_true(c: Column) -> Column:
    return F.sum(flag(c).cast("long"))


def cell_rollup(df: DataFrame, keys: list[str], base: Column, outcomes: dict[str, Column]) -> DataFrame:
    """Per key: n_total rows, n_cc rows with ``base``, and rows with base and each outcome."""
    b = flag(base)
    return keyed(df, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_total"), count_true(b).alias("n_cc"), *[count_true(b & flag(c)).alias(k) for k, c in outcomes.items()]
    )


def sufficient_stats(cells: DataFrame, keys: list[str], k: str, n: str) -> DataFrame:
    """(keys, k, n) with n > 0; blank keys are left out."""
    return keyed(cells, keys, blank_too=True).groupBy(*keys).agg(F.sum(k).alias("k"), F.sum(n).alias("n")).where("n > 0")


def stats_from_rows(df: DataFrame, keys: list[str], y: Column) -> DataFrame:
    """(keys, k, n) straight from rows: k true outcomes, n rows with an outcome."""
    return keyed(df, keys, blank_too=True).groupBy(*keys).agg(F.sum(y.cast("long")).alias("k"), F.count(y).alias("n")).where("n > 0")


def raw_prevalence(stats: DataFrame, keys: list[str]) -> DataFrame:
    return stats.groupBy(*keys).agg(F.round(F.coalesce(F.try_divide(F.sum("k"), F.sum("n")), F.lit(0.0)), 6).alias("prevalence"))


def members(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    return df.join(dimension.select(key).dropDuplicates(), key, "left_semi")


def unresolved(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` that the dimension doesn't know, with their number of rows."""
    return df.join(dimension.select(key).dropDuplicates(), key, "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def require_resolved(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """``df`` itself, or an error that names up to 20 unknown values."""
    bad = [r[0] for r in unresolved(df, dimension, key).select(key).limit(20).collect()]
    if bad:
        raise ValueError(f"{key} not in the dimension: {bad}")
    return df


def lookup(df: DataFrame, dimension: DataFrame, key: str, value: str, default, order: str | None = None) -> DataFrame:
    """``df`` with ``value`` from the dimension, or the default. Of several rows of a key the last by ``order`` wins (else the greatest value)."""
    d = last_wins(dimension, key, [order], [value]) if order else dimension.groupBy(key).agg(F.max(value).alias(value))
    return df.join(d, key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def last_wins(df: DataFrame, key: str, order: list[str], cols: list[str] | None = None) -> DataFrame:
    """One row per key that is present: the last by ``order`` (a line number, a time of arrival), combined before the shuffle."""
    cols = cols or [c for c in df.columns if c != key]
    row = F.max_by(F.struct(*cols), F.struct(*order)).alias("__row")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(row).select(key, *[F.col(f"__row.`{c}`").alias(c) for c in cols])


def left_attributes(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """``df`` with the dimension's columns, null where it has no row. A key that stands there twice is an error in the data: its least row counts."""
    cols = [c for c in dimension.columns if c != key and c not in df.columns]
    one = dimension.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*cols)).alias("__row")).select(key, *[F.col(f"__row.`{c}`").alias(c) for c in cols])
    return df.join(one, key, "left")


def override(df: DataFrame, key: str, value, columns: dict) -> DataFrame:
    """``df`` with several columns set where ``key`` has the value; the others keep theirs, also where the key is null."""
    hit = F.coalesce(F.col(key) == F.lit(value), F.lit(False))
    return df.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in columns.items()})


def without(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` without the columns, whether or not it has them: running a step twice does no harm."""
    return df.drop(*[c for c in columns if c in df.columns])


def where_given(df: DataFrame, equals: dict | None = None, among: dict | None = None, ignore: dict | None = None) -> DataFrame:
    """Optional predicates: those whose value is None (or empty) don't filter. ``ignore`` leaves out listed values and keeps nulls."""
    for c, v in (equals or {}).items():
        df = df if v is None else df.where(F.col(c) == F.lit(v))
    for c, v in (among or {}).items():
        df = df if not v else df.where(F.col(c).isin(list(v)))
    for c, v in (ignore or {}).items():
        df = df if not v else df.where(F.col(c).isNull() | ~F.col(c).isin(list(v)))
    return df


def distinct_counts(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Distinct values of each column (nulls not counted), over all rows or per key: one expansion, two exchanges."""
    return df.groupBy(*(keys or [])).agg(*[F.countDistinct(c).alias(f"n_{c}") for c in columns])


def require_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that state all of the columns."""
    return keyed(df, columns)


def join_counters(left: DataFrame, right: DataFrame, key: str, required: list[str]) -> DataFrame:
    """(n, n_used, n_no_match, n_missing): what an inner join with required columns uses and skips, in one pass.

    ``right`` holds one row per key (``last_wins``).
    """
    flag_ = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in required], F.lit(True))
    r = right.select(F.col(key), flag_.alias("__ok"))
    return left.select(key).join(r, key, "left").agg(
        F.count(F.lit(1)).alias("n"), count_true(F.col("__ok")).alias("n_used"), count_true(F.col("__ok").isNull()).alias("n_no_match"),
        count_true(~F.col("__ok")).alias("n_missing"),
    )


def min_volume(df: DataFrame, key: str, least: int) -> DataFrame:
    """Rows of keys with at least ``least`` rows."""
    return df.join(df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).select(key), key, "left_semi")


def any_true(cols: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [flag(F.col(c)) for c in cols])


def modal_value(df: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent non-blank value per key; ties go to the smallest value."""
    c = keyed(df, [key, value], blank_too=True).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    top = c.groupBy(key).agg(F.max("n").alias("n"))
    return c.join(top, [key, "n"]).groupBy(key).agg(F.min(value).alias(value), F.first("n").alias("n"))


def value_share(df: DataFrame, col: str) -> DataFrame:
    """Rows per value and their share of all rows in percent."""
    c = keyed(df, [col]).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n").alias("__t"))  # one row
    return c.join(F.broadcast(total)).select(col, "n", F.round(100.0 * F.col("n") / F.col("__t"), 4).alias("pct"))


def dense_index(df: DataFrame, col: str) -> DataFrame:
    """Zero-based rank of each distinct level. The window runs over the levels only."""
    return keyed(df, [col]).select(col).dropDuplicates().select(col, (F.dense_rank().over(Window.orderBy(col)) - 1).alias("idx"))


def first_group(stats: DataFrame, key: str, group: str, order: list[str]) -> DataFrame:
    """The group of a key in the first row by ``order``."""
    return stats.groupBy(key).agg(F.min_by(group, F.struct(*order)).alias(group))


def period_label(ts: Column, grain: str) -> Column:
    """``2021``, ``2021Q3`` or ``2021-07`` of a timestamp; null for null."""
    if grain == "yearly":
        return F.date_format(ts, "yyyy")
    if grain == "quarterly":
        return F.concat(F.date_format(ts, "yyyy"), F.lit("Q"), F.quarter(ts).cast("string"))
    if grain == "monthly":
        return F.date_format(ts, "yyyy-MM")
    raise ValueError(f"unknown grain {grain!r}")


def shares(counts: DataFrame, n: str, parts: dict[str, str]) -> DataFrame:
    """Percent of each part in ``n`` and the difference of the first two."""
    a, b = list(parts)[:2]
    out = counts.withColumns({k: F.round(100.0 * F.try_divide(F.col(v), F.col(n)), 4) for k, v in parts.items()})
    return out.withColumn("difference", F.round(F.col(a) - F.col(b), 4))


def first_writer_wins(target: DataFrame, incoming: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of ``incoming`` to append: keys the target doesn't hold, one row each.

    ``order`` names the arrival (a time, a file and line number), nulls last; rows that arrive together are told apart by
    their other columns, so the outcome doesn't depend on the partitions.
    """
    new = incoming.where(F.col(key).isNotNull()).join(target.select(key), key, "left_anti")
    cols = [c for c in incoming.columns if c != key]
    place = [x for c in order for x in (F.col(c).isNull(), F.col(c))] + [F.col(c) for c in cols if c not in order]
    row = F.min_by(F.struct(*cols), F.struct(*[c.alias(f"o{n}") for n, c in enumerate(place)])).alias("__row")
    return new.groupBy(key).agg(row).select(key, *[F.col(f"__row.`{c}`").alias(c) for c in cols])
