"""Quotas and cascaded caps over ranked rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.session import saved


def top_per_key(df: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each key. Spark filters by rank within tasks first (window group limit)."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def with_quota(df: DataFrame, passes: Column, key: str, quotas: dict[str, int], *order: Column) -> DataFrame:
    """Rows that pass, and for each key with a quota its best other rows up to the quota; ``topped`` marks those."""
    rows = df.withColumn("_in", passes)
    here = Window.partitionBy(key)
    missing = F.coalesce(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])[F.col(key)], F.lit(0)) - F.sum(F.col("_in").cast("int")).over(here)
    rank = F.row_number().over(Window.partitionBy(key, "_in").orderBy(*order))
    rows = rows.withColumn("_missing", missing).withColumn("_rank", rank)
    return rows.where(F.col("_in") | (F.col("_rank") <= F.col("_missing"))).withColumn("topped", ~F.col("_in")).drop("_in", "_missing", "_rank")


def cascaded_caps(df: DataFrame, first: str, n_first: int, second: str, n_second: int, *order: Column) -> DataFrame:
    """At most ``n_first`` rows of a first key, topped-up rows besides but counted; then ``n_second`` of a second key among those left."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(first).orderBy(*order)))
    left = ranked.where((F.col("_rank") <= n_first) | F.col("topped")).drop("_rank")
    return top_per_key(left, second, n_second, *order)


def global_rank(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``rows`` with their place from 1 in one order over all of them, without one task that takes them all.

    Rows are dealt by ranges of the order and written, ranked within their range, and moved on by the counts of the
    ranges before: one row a partition is all that is summed in one place. Ties in ``order`` have places in any order.
    """
    dealt = saved(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    moved = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(moved, "_range").withColumn(name, (F.col("_before") + within).cast("int")).drop("_range", "_before")
