"""Readers and writers of files as tables; schemas are given, never inferred from the data at scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_json(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """JSON files of objects or lists, each row with the file that it came from."""
    return spark.read.schema(schema).json(paths, multiLine=True).withColumn("origin", F.col("_metadata.file_name"))


def read_terms(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Weighted terms: weights from 1 to 60, the first of terms that fold alike, blank ones dropped."""
    from tidewire.functions.text import fold

    rows = read_json(spark, paths, "term string, weight int, channel string, active boolean").where("coalesce(trim(term), '') <> ''")
    rows = rows.withColumn("weight", F.least(F.greatest(F.coalesce("weight", F.lit(1)), F.lit(1)), F.lit(60))).withColumn("key", fold(F.col("term")))
    return rows.groupBy("key").agg(F.min(F.struct("origin", "term", "weight", "channel", "active")).alias("r")).select("key", "r.*")


def read_sources(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of sources as (url, kind, name): ordinals stripped, feeds and sitemaps told apart, repeats dropped."""
    rows = spark.read.text(paths).select(F.regexp_extract("value", r"(https?://\S+)", 1).alias("url"), F.trim(F.regexp_extract("value", r"^\s*(?:\d+[.)-]\s*)?([^|]*?)\s*[|:-]?\s*https?://", 1)).alias("given")).where("url <> ''")
    low = F.lower("url")
    kind = F.when(low.rlike("sitemap"), "sitemap").when(low.rlike("rss|feed|atom|[.]xml"), "rss").otherwise("page")
    name = F.when(F.col("given") != "", F.col("given")).otherwise(F.regexp_extract("url", r"://(?:www\.)?([^/]+)", 1))
    return rows.groupBy("url").agg(F.min("given").alias("given")).select("url", kind.alias("kind"), name.alias("name"))


def read_log_hits(spark: SparkSession, paths: list[str], markers: tuple[str, ...], tail: int = 5000, width: int = 500) -> DataFrame:
    """(file, line, text) of the last ``tail`` lines of each log (the feature) that hold a marker."""
    rows = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.split("value", "\n").alias("lines"))
    rows = rows.select("file", F.size("lines").alias("n"), F.posexplode("lines").alias("line", "text")).where(F.col("line") >= F.col("n") - tail)
    hit = F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(F.lower("text"), m))
    return rows.where(hit).select("file", (F.col("line") + 1).alias("line"), F.substring("text", 1, width).alias("text"))


def read_csv(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(paths, header=True)


def append_json(df: DataFrame, folder: str) -> None:
    df.write.mode("append").json(folder)


def write_csv(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").csv(folder, header=True)


def write_parquet(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").parquet(folder)


def new_candidates(candidates: DataFrame, queue: DataFrame, blocked: DataFrame, key: str = "link") -> tuple[DataFrame, DataFrame]:
    """(rows to insert, counts by outcome) of a batch of candidates against the queue and the blocked links."""
    given = F.coalesce(F.col(key), F.lit(""))
    known, bad = queue.select(F.col(key).alias("_q")).distinct(), blocked.select(F.col(key).alias("_b")).distinct()
    order = F.row_number().over(Window.partitionBy(key).orderBy(*[c for c in candidates.columns if c != key]))
    rows = candidates.withColumn("_n", order).join(known, given == F.col("_q"), "left").join(bad, given == F.col("_b"), "left")
    outcome = F.when(given == "", "no_link").when(F.col("_b").isNotNull(), "blocked").when(F.col("_q").isNotNull() | (F.col("_n") > 1), "duplicate").otherwise("inserted")
    rows = rows.withColumn("outcome", outcome)
    return rows.where("outcome = 'inserted'").select(*candidates.columns), rows.groupBy("outcome").agg(F.count("*").alias("n"))
