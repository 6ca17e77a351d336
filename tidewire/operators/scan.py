"""Scans of feeds and sitemaps: what a run accepts of parsed items, and the parser that a text is read with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators.similar import similar_across
from tidewire.session import saved


def scan_feeds(items: DataFrame, now: Column, hours: int, entries: int = 30, per_feed: int = 10) -> DataFrame:
    """``items`` (feed, place, date, ...) that a run accepts, with ``rescued``.

    Of the first ``entries`` places of a feed, the first ``per_feed`` dated within ``hours`` before ``now`` are
    accepted. A feed with none gives its first dated row, marked ``rescued``. Rows without a date are never accepted.
    """
    age = now.cast("timestamp_ntz") - F.col("date").cast("timestamp_ntz")
    inside = F.coalesce((age >= F.expr("interval '0' second")) & (age <= F.make_dt_interval(hours=F.lit(hours))), F.lit(False))
    rows = items.where(F.col("place") < entries).withColumn("_in", inside)
    feed = Window.partitionBy("feed")
    rows = rows.withColumn("_any", F.max("_in").over(feed))
    rank = F.row_number().over(Window.partitionBy("feed", "_in", F.col("date").isNull()).orderBy("place"))
    rows = rows.withColumn("_r", rank).withColumn("rescued", ~F.col("_any"))
    accepted = (F.col("_in") & (F.col("_r") <= per_feed)) | (F.col("rescued") & F.col("date").isNotNull() & (F.col("_r") == 1))
    return rows.where(accepted).drop("_in", "_any", "_r")


def best_parser(parsed: DataFrame, key: str = "feed") -> DataFrame:
    """(key, parser, n) of the parser that gives a text most rows; ``parsed`` is (key, parser, place of preference); ties go to the lower place."""
    counts = parsed.groupBy(key, "parser", "preferred").agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.max_by(F.struct("parser", "n"), F.struct("n", -F.col("preferred"))).alias("b")).select(key, "b.parser", "b.n")


def newest_and_first_match(rows: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """(id, newest, first): the known titles that are like a row's, the latest by ``at`` and the earliest by ``id``.

    ``rows`` is (id, ts) and ``known`` (id, ts, at), ``ts`` the distinct tokens. Titles of equal tokens are one class on
    either side, so copies make no pairs; the pairs of classes are ``similar_across``'. Titles without tokens match nothing.
    """
    told = rows.where(F.size("ts") > 0).select("ts", F.lit(True).alias("in_a"), F.lit(None).cast(known.select(F.struct("at", "id")).schema[0].dataType).alias("own"))
    held = known.where(F.size("ts") > 0).select("ts", F.lit(False).alias("in_a"), F.struct("at", "id").alias("own"))
    classes = told.union(held).groupBy(F.col("ts").alias("words")).agg(F.max("in_a").alias("in_a"), F.max("own").alias("last"), F.min("own.id").alias("least"), F.count_if(~F.col("in_a")).alias("held"))
    classes = saved(classes.withColumn("in_b", F.col("held") > 0).withColumn("key", F.md5(F.to_json("words"))))
    pairs = similar_across(classes, least)
    found = pairs.join(classes.select(F.col("key").alias("b"), "last", "least"), "b").groupBy("a").agg(F.max("last").alias("last"), F.min("least").alias("first"))
    by_words = classes.select(F.col("key").alias("a"), F.col("words").alias("ts")).join(found, "a").drop("a")
    return rows.join(by_words, "ts").select("id", F.col("last.id").alias("newest"), "first")
