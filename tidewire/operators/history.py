"""Rows against history: ordered rejections, upserts and merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reject_in_order(df: DataFrame, checks: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """Adds ``rejected``: the name of the first check whose table holds the row's key, else null.

    Each check is (name, table of one column of distinct keys, key column of ``df``).
    """
    reasons = []
    for i, (name, keys, column) in enumerate(checks):
        side = keys.select(F.col(keys.columns[0]).alias(f"_k{i}")).distinct()
        df = df.join(side, F.col(column) == F.col(f"_k{i}"), "left")
        reasons.append(F.when(F.col(f"_k{i}").isNotNull(), name))
    return df.withColumn("rejected", F.coalesce(*reasons)).drop(*[f"_k{i}" for i in range(len(reasons))])


def upsert(old: DataFrame, new: DataFrame, key: str, tombstone: Column) -> DataFrame:
    """New rows replace old ones of their key, unless the old row is a tombstone; both have the same columns."""
    dead = old.where(tombstone).select(key)
    fresh = new.join(dead, key, "left_anti")
    return old.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def counting_upsert(events: DataFrame, key: Sequence[str], order: Column, last: Sequence[str]) -> DataFrame:
    """One row a key: how often it came, and the last writer's other fields."""
    latest = F.max(F.struct(order.alias("_o"), *last))
    return events.groupBy(*key).agg(F.count("*").alias("recurrence"), latest.alias("_last")).select(*key, "recurrence", *[F.col(f"_last.{c}").alias(c) for c in last])


def fill_empty(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Left rows whose empty fields take the right side's; filled ones stay."""
    side = right.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = left.join(side, key, "left")
    filled = {c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col(c)).otherwise(F.col(f"_{c}")) for c in columns}
    return joined.withColumns(filled).select(*left.columns)
