"""Floored proportional samples: strata, allocation, round-robin draws with a cap, exact splits.

Random order is the MD5 of seed and key, so a draw is the same on every engine and at every partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shuffle_key(seed: int, *cols: Column) -> Column:
    return F.md5(F.concat_ws("/", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def binned(x: Column, low: Column, high: Column) -> Column:
    return F.when(x < low, "low").when(x < high, "medium").otherwise("high")


def allocation(strata: DataFrame, keys: list[str], size: str, target: int, floor: int) -> DataFrame:
    """Sample size of each stratum: a floor, the rest in proportion (half to even), then deficits into the largest strata.

    Windows run over the strata, of which there are few; rows are only counted.
    """
    all_ = Window.partitionBy()
    s = strata.withColumn("__n", F.count(F.lit(1)).over(all_)).withColumn("__t", F.sum(size).over(all_))
    rest = F.greatest(F.lit(0), F.lit(target) - F.col("__n") * floor)
    s = s.withColumn("__q", F.least(F.col(size), floor + F.bround(rest * F.col(size) / F.col("__t")).cast("long")))
    s = s.withColumn("__gap", F.greatest(F.lit(0), F.lit(target) - F.sum("__q").over(all_))).withColumn("__room", F.col(size) - F.col("__q"))
    before = Window.orderBy(F.col(size).desc(), *keys).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("__used", F.coalesce(F.sum("__room").over(before), F.lit(0)))
    add = F.greatest(F.lit(0), F.least(F.col("__room"), F.col("__gap") - F.col("__used")))
    return s.select(*keys, size, (F.col("__q") + add).cast("long").alias("n_sample"))


#: Hexadecimal digits of a shuffle key that make its bucket.
BUCKET_DIGITS = 3


def with_rows_before(rows: DataFrame, keys: list[str], bucket: Column) -> DataFrame:
    """``rows`` with ``__b``, their bucket, and ``__before``, the rows of their group in lower buckets.

    Rows are counted per group and bucket; the window runs over these counts, as many as there are buckets.
    """
    h = rows.withColumn("__b", bucket)
    n = h.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    lower = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    c = n.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__b").alias("__kb"), F.coalesce(F.sum("__n").over(lower), F.lit(0)).alias("__before"))
    on = h["__b"].eqNullSafe(c["__kb"])
    for i, k in enumerate(keys):
        on = on & h[k].eqNullSafe(c[f"__k{i}"])
    return h.join(c, on, "left").drop("__kb", *[f"__k{i}" for i in range(len(keys))])


def bucketed_rank(rows: DataFrame, keys: list[str], bucket: Column, order: list[str]) -> DataFrame:
    """``rows`` with ``__rank``, from 1: the place of a row in its group by ``order``, which ``bucket`` must follow.

    Groups may be of any size: rows are ranked within a bucket, to which the counts of the buckets before are added, so the
    largest group is sorted by as many tasks as it has buckets instead of one.
    """
    within = F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(*order))
    return with_rows_before(rows, keys, bucket).withColumn("__rank", within + F.col("__before")).drop("__b", "__before")


def shuffled_rank(rows: DataFrame, keys: list[str], hash_: str, key: str, digits: int = BUCKET_DIGITS) -> DataFrame:
    """``bucketed_rank`` in the order of a hexadecimal hash; its first digits make the bucket."""
    return bucketed_rank(rows, keys, F.substring(hash_, 1, digits), [hash_, key])


def round_robin(rows: DataFrame, plan: DataFrame, keys: list[str], country: str, key: str, cap: int, seed: int, digits: int = BUCKET_DIGITS) -> DataFrame:
    """``n_sample`` rows per stratum, one country after another in shuffled order, at most ``cap`` of a country while others last.

    Only the first ``n_sample`` rows of a (stratum, country) in shuffled order can be drawn: rows whose bucket of the hash
    begins beyond that are left out before anything is sorted, so the windows see a small multiple of the sample.
    """
    h = rows.join(plan.select(*keys, "n_sample"), keys).withColumn("__h", shuffle_key(seed, F.col(key)))
    h = with_rows_before(h, [*keys, country], F.substring("__h", 1, digits)).where(F.col("__before") < F.col("n_sample")).drop("__b", "__before")
    h = h.withColumn("__i", F.row_number().over(Window.partitionBy(*keys, country).orderBy("__h", key)) - 1).where(F.col("__i") < F.col("n_sample"))
    h = h.withColumn("__ch", shuffle_key(seed, F.col(country), *[F.col(k) for k in keys]))
    h = h.withColumn("__c", F.dense_rank().over(Window.partitionBy(*keys).orderBy("__ch", country)))
    over, under = F.col("__i") >= cap, F.col("__i") < cap
    order = [over, F.when(under, F.col("__i")).otherwise(F.col("__c")), F.when(under, F.col("__c")).otherwise(F.col("__i"))]
    h = h.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return h.where(F.col("__k") <= F.col("n_sample")).drop("__h", "__i", "__ch", "__c", "__k", "n_sample")


def quotas(counts: DataFrame, by: str, n: str, parts: list[tuple[str, float]]) -> DataFrame:
    """``counts`` with one column per part: that share of all rows, rounded up, divided over the classes by largest remainders.

    Each part is taken from what the parts before have left. What a class can't give goes to the class with the next
    remainder; ties go to the first class. Windows run over the classes, of which there are few.
    """
    all_ = Window.partitionBy()
    left = counts.withColumn("__left", F.col(n).cast("long"))
    for name, share in parts:
        left = left.withColumn("__all", F.sum("__left").over(all_)).withColumn("__want", F.ceil(F.round(F.col("__all") * F.lit(share), 9)))
        exact = F.col("__want") * F.col("__left") / F.greatest(F.col("__all"), F.lit(1))
        left = left.withColumn("__floor", F.floor(exact)).withColumn("__rest", F.round(exact - F.floor(exact), 9))
        place = F.row_number().over(Window.orderBy(F.desc("__rest"), by))
        left = left.withColumn("__gap", F.col("__want") - F.sum("__floor").over(all_)).withColumn(name, (F.col("__floor") + F.when(place <= F.col("__gap"), 1).otherwise(0)).cast("long"))
        left = left.withColumn("__left", F.col("__left") - F.col(name))
    return left.drop("__left", "__all", "__want", "__floor", "__rest", "__gap")


def exact_split(rows: DataFrame, key: str, combo: str, shares: tuple[float, float], seed: int) -> DataFrame:
    """``rows`` with ``split``: test is the first share of all rows, validation the second share of the others, the rest train.

    Each class gives its largest-remainder quota, its rows in shuffled order: test first, then validation. A class of one
    row goes where its remainder puts it. Null keys stand after the others of equal order.
    """
    q = quotas(rows.groupBy(combo).agg(F.count(F.lit(1)).alias("__n")), combo, "__n", [("__test", shares[0]), ("__valid", shares[1])])
    q = q.select(F.col(combo).alias("__combo"), "__test", "__valid")
    h = shuffled_rank(rows.withColumn("__h", shuffle_key(seed, F.col(key))), [combo], "__h", key)
    h = h.join(q, h[combo].eqNullSafe(q["__combo"]), "left")
    split = F.when(F.col("__rank") <= F.col("__test"), "test").when(F.col("__rank") <= F.col("__test") + F.col("__valid"), "validation").otherwise("train")
    return h.withColumn("split", split).drop("__h", "__rank", "__combo", "__test", "__valid")


def top_or_other(c: Column, top: list) -> Column:
    """The value if it is one of ``top``, else ``other``."""
    return F.when(c.isin(list(top)), c).otherwise("other")


def most_frequent(df: DataFrame, column: str, n: int) -> list:
    """The n most frequent values that are present, ties in order of the value (n rows come to the driver)."""
    c = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
    return [r[0] for r in c.orderBy(F.desc("__n"), column).limit(n).collect()]


def thresholds(df: DataFrame, column: str, at: tuple[float, ...] = (0.333, 0.666)) -> list[float]:
    """Exact percentiles of a column, for ``binned``."""
    return list(df.agg(F.percentile(column, F.array(*map(F.lit, at)))).first()[0] or [0.0] * len(at))


def first_sources(df: DataFrame, column: str, n: int, ignore: list | None = None) -> DataFrame:
    """Rows of the first n sources in order of their names, ignored ones left out."""
    one = df.where(F.col(column).isNotNull() & ~F.col(column).isin(list(ignore or []))).select(column).distinct().orderBy(column).limit(n)
    return df.join(one, column, "left_semi")
