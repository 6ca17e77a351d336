"""Keyed and fuzzy deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.operators.similar import SHORT, similar_classes


def keep_best(df: DataFrame, key: Column, *order: Column, drop_empty: bool = True) -> DataFrame:
    """One row a key, the first in ``order``; empty and null keys are dropped, or all kept.

    The best row is found by ``min_by``-like aggregation, so a hot key is combined before it is shuffled.
    """
    rows = df.withColumn("_key", key)
    empty = F.coalesce(F.col("_key"), F.lit("")) == ""
    ranked = rows.where(~empty).groupBy("_key").agg(F.min(F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*df.columns).alias("_row"))).alias("_best"))
    best = ranked.select("_best._row.*")
    return best if drop_empty else best.union(rows.where(empty).select(*df.columns))


def similar_pairs(df: DataFrame, id_col: str, tokens_col: str, least: float) -> DataFrame:
    """(a, b, similarity): pairs of token sets whose Jaccard similarity is at least ``least``; a and b are the least ids of their sets.

    Rows of equal sets are one class, so copies make no pairs; the pairs of classes are ``similar_classes``'.
    """
    sets = df.where(F.size(tokens_col) > 0).groupBy(F.col(tokens_col).alias("words")).agg(F.min(id_col).alias("key"))
    return similar_classes(sets, least, longs=SHORT, rounds=1)


def greedy_leaders(rows: DataFrame, pairs: DataFrame, save) -> DataFrame:
    """Ids that an ordered greedy pass accepts: in id order, those with no accepted earlier neighbour.

    Each round decides, in joins, the ids whose earlier neighbours are all decided: accepted if none
    of them is, dropped as soon as one is. ``pairs`` has a < b; ``save`` writes a table and reads it
    again, which cuts the lineage of a round. Not transitive: of a chain the ends can both stay.
    """
    open_ = save(pairs.select("a", "b"), "open-0")
    step, dropped = 0, None
    while not open_.isEmpty():
        step += 1
        late = open_.select(F.col("b").alias("id")).distinct()
        leaders = open_.select(F.col("a").alias("id")).distinct().join(late, "id", "left_anti")
        gone = save(open_.join(leaders, open_.a == leaders.id, "left_semi").select(F.col("b").alias("id")).distinct(), f"gone-{step}")
        dropped = gone if dropped is None else dropped.union(gone)
        left = open_.join(gone, open_.a == gone.id, "left_anti").join(gone, F.col("b") == gone.id, "left_anti")
        open_ = save(left.join(leaders, left.a == leaders.id, "left_anti"), f"open-{step}")
    return rows if dropped is None else rows.join(dropped, "id", "left_anti")
