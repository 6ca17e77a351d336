"""Connected components by alternating large-star and small-star steps, all in DataFrame joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u moves to the least of u and its neighbours."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours move to the least of them; every edge has u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(scratch: Scratch, edges: DataFrame, label: str = "cc") -> DataFrame:
    """(node, component) for every node on an edge; component is the smallest node of its class.

    ``edges`` has two columns of one orderable type. Rows with a null end and loops are left out;
    repeated edges and both directions count once. No edges: no rows. Group minima are combined
    before they are shuffled, so a hub with a large part of all edges costs one row a task; the
    joins have one row a node on one side, so Spark can split a hub's rows on the other. Each round
    is written to the shared folder.
    """
    a, b = edges.columns[:2]
    left, right = F.col(a), F.col(b)
    now = scratch.keep(
        edges.where(left.isNotNull() & right.isNotNull() & (left != right))
        .select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .distinct(),
        f"{label}-0",
    )
    mark, step = None, 0
    while True:
        # equal counts and equal sums of hashes: the edges did not change
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or seen[0] == 0:
            break
        mark, step = seen, step + 1
        now = scratch.keep(_small_star(_large_star(now)), f"{label}-{step}")
        scratch.drop(f"{label}-{step - 1}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
