"""Types of articles: by channel, by the clues that a text holds, and by what a channel stands for."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TypeRules:
    """``ordered``: channels whose first type with a clue wins, else the last of them, whatever other clues say; ``fixed``: channels of one type;
    ``types``: the others, of which the one with most clues wins, the earlier of equals; ``fallback``: what a channel stands for without any clue."""

    types: Sequence[str]
    ordered: Mapping[str, Sequence[str]] = field(default_factory=dict)
    fixed: Mapping[str, str] = field(default_factory=dict)
    fallback: Mapping[str, str] = field(default_factory=dict)
    default: str = "hard_news"


def article_types(rows: DataFrame, hits: DataFrame, rules: TypeRules, id_col: str = "id", channel_col: str = "channel") -> DataFrame:
    """``rows`` with ``type``; ``hits`` are match_terms' rows (id, part, ...) with types as parts. Null channels have no rule of their own; rows that share an id share its clues."""
    clues = hits.groupBy(id_col, "part").agg(F.count("*").alias("n")).groupBy(F.col(id_col).alias("_id")).agg(F.map_from_entries(F.collect_list(F.struct("part", "n"))).alias("_clues"))
    count = lambda t: F.coalesce(F.try_element_at("_clues", F.lit(t)), F.lit(0))
    best = F.array_max(F.array(*[F.struct(count(t).alias("n"), F.lit(-i).alias("i"), F.lit(t).alias("type")) for i, t in enumerate(rules.types)]))
    kind = F.when(F.lit(False), "")
    for channel, types in rules.ordered.items():
        first = F.coalesce(*[F.when(count(t) > 0, t) for t in types[:-1]], F.lit(types[-1]))
        kind = kind.when(F.col(channel_col) == channel, first)
    for channel, type_ in rules.fixed.items():
        kind = kind.when(F.col(channel_col) == channel, type_)
    kind = kind.when(best["n"] > 0, best["type"])
    for channel, type_ in rules.fallback.items():
        kind = kind.when(F.col(channel_col) == channel, type_)
    joined = rows.join(clues, F.col(id_col).eqNullSafe(F.col("_id")), "left")
    return joined.withColumn("type", kind.otherwise(rules.default)).drop("_id", "_clues")
