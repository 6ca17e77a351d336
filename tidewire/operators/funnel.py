"""The ingestion funnel: first rejecting stage, quotas in input order, caps over batches, keyed jobs and merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators.classify import gate


def first_stage(df: DataFrame, *stages: tuple[str, Column], passed: str = "accepted") -> DataFrame:
    """Adds ``stage``: the name of the first stage whose condition holds; null does not hold. Each row counts once."""
    return df.withColumn("stage", gate(*[(c, name) for name, c in stages], passed=passed))


def minimum_quota(df: DataFrame, batch: str, order: Sequence[Column], strong: Column, quota: int = 2) -> DataFrame:
    """Rows that an ordered pass over each batch accepts: strong rows, and weak ones while fewer than ``quota`` rows were accepted.

    Until the quota is full every row is accepted, so these are the first ``quota`` rows of a batch and the strong
    ones among the rest; ``promoted`` marks the weak. A null condition is weak.
    """
    place = F.row_number().over(Window.partitionBy(batch).orderBy(*order))
    rows = df.withColumn("_strong", F.coalesce(strong, F.lit(False))).withColumn("_place", place)
    return rows.where(F.col("_strong") | (F.col("_place") <= quota)).withColumn("promoted", ~F.col("_strong")).drop("_strong", "_place")


def run_caps(df: DataFrame, source: str, per_source: int, total: int, *order: Column) -> DataFrame:
    """Rows that counters of one run accept in order: ``per_source`` of each source, ``total`` in all (the feature: the size of a run).

    A full source takes none of the total, so rows are ranked by source first and the total cuts the rest.
    """
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(source).orderBy(*order)))
    return ranked.where(F.col("_rank") <= per_source).drop("_rank").orderBy(*order).limit(total)


def without_sources(df: DataFrame, other: DataFrame, url: str, name: str) -> DataFrame:
    """Adds ``removed``: another list has a source with the row's normal URL or its exact name; empty values match none."""
    normal = lambda c: F.lower(F.regexp_replace(F.trim(c), "/+$", ""))
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    urls = other.select(normal(F.col(url)).alias("_u")).where(~blank(F.col("_u"))).distinct()
    names = other.select(F.col(name).alias("_n")).where(~blank(F.col("_n"))).distinct()
    joined = df.join(urls, normal(F.col(url)) == F.col("_u"), "left").join(names, F.col(name) == F.col("_n"), "left")
    return joined.withColumn("removed", F.col("_u").isNotNull() | F.col("_n").isNotNull()).drop("_u", "_n")


def queue_jobs(df: DataFrame, key: str, priority: Column, *order: Column) -> DataFrame:
    """One job a key: the last priority job, which replaces what was queued, else the first normal one, which blocks later ones."""
    row = F.struct(*df.columns)
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    urgent = F.coalesce(priority, F.lit(False))
    best = df.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.when(urgent, row), F.when(urgent, place)).alias("_p"), F.min_by(row, place).alias("_n"))
    return best.select(F.coalesce("_p", "_n").alias("_j")).select("_j.*")


def merge_configs(df: DataFrame, key: Column, fill: Sequence[str], greatest: Sequence[str], origin: str, *order: Column) -> DataFrame:
    """One row a key: the first non-empty value of each ``fill`` column in order, the greatest of the others, and all origins as a sorted list."""
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    first = [F.min_by(F.col(c), F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", place)).alias(c) for c in fill]
    return df.groupBy(key.alias("key")).agg(*first, *[F.max(c).alias(c) for c in greatest], F.array_sort(F.collect_set(origin)).alias("origins"))


def split_known(df: DataFrame, known: DataFrame, key: Column) -> DataFrame:
    """Adds ``known``: the first 20 hex digits of the SHA-256 of the row's key are in the one column of ``known``."""
    seen = known.select(F.col(known.columns[0]).alias("_k")).where("_k is not null").distinct()
    return df.withColumn("finding", F.substring(F.sha2(key, 256), 1, 20)).join(seen, F.col("finding") == F.col("_k"), "left").withColumn("known", F.col("_k").isNotNull()).drop("_k")
