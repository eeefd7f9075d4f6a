"""Readers: format dispatch, JSON lines with line numbers, dictionaries, seed lists, crawl folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RAW = "url string, title string, body string, lang string, dateTime string, source_uri string"


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, schema: str | None = None) -> DataFrame:
    """CSV (also gzipped, blank = null) or Parquet by extension; ``source_uri`` reads as ``source`` if that is absent."""
    if path.endswith((".csv", ".csv.gz")):
        r = spark.read.option("header", True).option("nullValue", "").option("escape", '"').option("multiLine", True)
        df = r.schema(schema).csv(path) if schema else r.option("inferSchema", True).csv(path)
    else:
        df = spark.read.parquet(path)
    if "source_uri" in df.columns and "source" not in df.columns:
        df = df.withColumnRenamed("source_uri", "source")
    return df.select(*columns) if columns else df


def read_jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def read_json_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a malformed line is an error, blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_lenient(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """JSON lines; malformed lines and records without a key are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where(F.col(key).isNotNull())


def read_years(spark: SparkSession, path: str, years: list[int] | None = None, column: str = "year") -> DataFrame:
    """A Parquet folder partitioned by year, or one file of it; with ``years`` only those partitions are read."""
    df = spark.read.parquet(path)
    return df.where(F.col(column).isin(years)) if years and column in df.columns else df


def read_draws(spark: SparkSession, path: str) -> DataFrame:
    """Draws of a trace written by ``write_draws``: (param, level, chain, draw, value)."""
    return spark.read.parquet(path).select("param", "level", "chain", "draw", "value")


def read_numbered_json(spark: SparkSession, path: str, schema: str = RAW) -> DataFrame:
    """(source, line_no, record...): lines counted from 1 with bad ones, which have no row; the source is the file's name.

    A file is split as usual. A line's number is its place in its partition, plus the lines of the same file in the partitions
    before it: one row per file and partition is summed up for that.
    """
    t = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_name").alias("__name"), F.col("_metadata.file_block_start").alias("__at"))
    t = t.withColumn("__id", F.monotonically_increasing_id())
    # lines of a block have consecutive ids, blocks of a file follow each other by their start
    blocks = t.groupBy("__f", "__at").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__f").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("__f", "__at", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    source = F.regexp_replace(F.regexp_replace("__name", r"\.jsonl(\.gz)?$", ""), r"_climate(_pass\d+)?$", "")
    rec = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    ok = F.col("value").rlike(r"^\s*\{") & F.expr("try_parse_json(value) is not null")
    lines = t.where(ok).join(blocks, ["__f", "__at"])
    return lines.select(source.alias("source"), (F.col("__id") - F.col("__first") + F.col("__before") + 1).alias("line_no"), rec.alias("r")).select("source", "line_no", "r.*")


def read_keyword_json(spark: SparkSession, path: str) -> DataFrame:
    """(topic, lang, pos, term) of a nested dictionary topic -> language -> terms."""
    t = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,array<string>>>").alias("m"))
    a = t.select(F.explode("m").alias("topic", "by")).select("topic", F.explode("by").alias("lang", "terms"))
    return a.select("topic", "lang", F.posexplode("terms").alias("pos", "term"))


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Lines without outer white space and quotes; blank ones are dropped."""
    from tidemark.functions.text import unicode_trim

    v = unicode_trim(F.col("value"))
    for q in ('"', "'"):
        v = F.regexp_replace(v, f"^{q}+|{q}+$", "")
    return spark.read.text(path).select(v.alias("value")).where("value <> ''")


def line_counts(spark: SparkSession, glob: str) -> DataFrame:
    """(file, n) of text files, gzipped ones included."""
    return spark.read.text(glob).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))


def count_existing(spark: SparkSession, path: str) -> int:
    """Lines of an output, 0 where there is none."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return 0
    return spark.read.text(path).count()


def source_status(spark: SparkSession, outlets: DataFrame, root: str) -> DataFrame:
    """Outlets with whether and how much was collected; of two folders for one host the last in order wins."""
    from tidemark.functions.text import folder_name

    n = line_counts(spark, f"{root}/*/*/crawls/*.jsonl.gz").withColumn("parts", F.regexp_extract_all("file", F.lit(r"([^/]+)/([^/]+)/crawls/[^/]+$"), 0))
    n = n.select(F.regexp_extract("file", r"([^/]+)/[^/]+/crawls/[^/]+$", 1).alias("collection"), F.regexp_extract("file", r"([^/]+)/crawls/[^/]+$", 1).alias("folder"), "n")
    per = n.groupBy("folder", "collection").agg(F.sum("n").alias("n")).groupBy("folder").agg(F.max_by(F.struct("collection", "n"), "collection").alias("c"))
    o = outlets.withColumn("folder", folder_name(F.col("website_url"))).join(per, "folder", "left")
    return o.select("country", "rank", "name", "website_url", "language", F.when(F.col("c").isNotNull(), "Yes").otherwise("No").alias("collected"),
                    F.coalesce(F.col("c.n"), F.lit(0)).alias("article_count"), F.coalesce(F.col("c.collection"), F.lit("")).alias("collection_id"), "folder")
