"""Writers: CSV, Parquet and JSON lines; append without duplicates; error rows apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.operators.posterior import output_name
from tidemark.operators.rollup import first_writer_wins


def write_csv(df: DataFrame, path: str, force: bool = True, one_file: bool = False) -> None:
    """One file only for the small published tables."""
    out = df.coalesce(1) if one_file else df
    out.write.mode("overwrite" if force else "errorifexists").option("header", True).option("emptyValue", "").csv(path)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None, force: bool = True) -> None:
    w = df.write.mode("overwrite" if force else "errorifexists")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_draws(draws: DataFrame, path: str, force: bool = True) -> None:
    """A trace: the draws in long form, one folder per parameter."""
    write_parquet(draws, path, by=["param"], force=force)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append_new(incoming: DataFrame, path: str, key: str, order: list[str], dry_run: bool = False) -> dict[str, int]:
    """Append the rows whose key the target lacks, one per key; how many were inserted and skipped.

    Counted while writing: the target is read once, for its keys alone, and ``incoming`` once. One writer at a time: two
    that append at once can both bring a key. ``dry_run`` counts and writes nothing.
    """
    spark = incoming.sparkSession
    target = spark.read.parquet(path).select(key) if _exists(spark, path) else spark.createDataFrame([], incoming.select(key).schema)
    taken, kept = Observation(), Observation()
    new = first_writer_wins(target, incoming.observe(taken, F.count(F.lit(1)).alias("n")), key, order).select(*incoming.columns).observe(kept, F.count(F.lit(1)).alias("n"))
    if dry_run:
        new.write.format("noop").mode("overwrite").save()
    else:
        new.write.mode("append").parquet(path)
    return {"inserted": kept.get["n"], "skipped": taken.get["n"] - kept.get["n"]}


def with_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with the columns (name: type) it lacks, null in every row; those it has stay."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def updated(target: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``target`` with the columns set to the values of ``updates`` where it has the key (nulls included); other rows keep theirs.

    ``updates`` holds one row per key; every row of the target with that key is set.
    """
    u = updates.where(F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.struct(*columns).alias("__new"))
    x = target.join(u, F.col(key) == F.col("__key"), "left")
    return x.select(*[F.when(F.col("__new").isNotNull(), F.col(f"__new.`{c}`")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns])


def update_table(spark, path: str, updates: DataFrame, key: str, columns: dict[str, str]) -> None:
    """UPDATE by key of a Parquet folder, adding the columns it lacks: written beside it, then put in its place."""
    target = with_columns(spark.read.parquet(path), columns)
    new = path.rstrip("/") + "__new"
    updated(target, updates, key, list(columns)).write.mode("overwrite").parquet(new)
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    fs = jpath(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(jpath(path), True)
    fs.rename(jpath(new), jpath(path))


def write_summaries(draws: DataFrame, summarise, folder: str, category: str, group: str, time: str | None = None) -> list[str]:
    """One CSV per kind of result in ``draws`` (param), named by kind, category, group and time; the names written."""
    names = []
    for (kind,) in draws.where("param like 'prevalence%'").select("param").distinct().orderBy("param").collect():  # a handful of kinds
        names.append(output_name(kind, category, group, time))
        write_csv(summarise(draws.where(F.col("param") == kind)), f"{folder}/{names[-1]}.csv", one_file=True)
    return names


def split_errors(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Rows without an error, and (key columns, error cut to 100 characters) of the others."""
    bad = df.where(F.col(error).isNotNull()).withColumn(error, F.left(F.col(error), F.lit(100)))
    return df.where(F.col(error).isNull()), bad
