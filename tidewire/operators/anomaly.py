"""Isolation forest: trees on bounded samples, as the method asks; every row is scored."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expected_depth(n: int) -> float:
    """Mean depth of an unsuccessful search among n values."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def grow(x: np.ndarray, rng: np.random.Generator, depth: int) -> tuple:
    """A tree of (feature, cut, left, right) or (added depth,) leaves."""
    spread = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) > 1 else []
    if depth == 0 or len(spread) == 0:
        return (expected_depth(len(x)),)
    f = int(rng.choice(spread))
    cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    low = x[:, f] < cut
    return f, cut, grow(x[low], rng, depth - 1), grow(x[~low], rng, depth - 1)


def depths(tree: tuple, x: np.ndarray, depth: int = 0) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), depth + tree[0])
    f, cut, left, right = tree
    low = x[:, f] < cut
    out = np.empty(len(x))
    out[low], out[~low] = depths(left, x[low], depth + 1), depths(right, x[~low], depth + 1)
    return out


def anomalies(df: DataFrame, key: str, features: Sequence[str], trees: int = 100, sample: int = 256, share: float = 0.05, seed: int = 7) -> DataFrame:
    """(key, score, anomaly): isolation scores of all rows, and whether a score is above the quantile 1 - ``share`` of them.

    Null features count as 0. Trees grow on ``sample`` rows each, drawn from at most 16 times as many rows
    (those with the least hash of the key), so the driver holds a bounded part; every row is scored in tasks.
    Fewer than ten rows: all scores are null and none is an anomaly.
    """
    rows = df.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    drawn = rows.orderBy(F.xxhash64(key), key).limit(16 * sample).select(*features).toPandas().to_numpy(dtype=np.float64)
    if len(drawn) < 10:
        return rows.select(key, F.lit(None).cast("double").alias("score"), F.lit(False).alias("anomaly"))
    rng = np.random.default_rng(seed)
    size = min(sample, len(drawn))
    forest = [grow(drawn[rng.choice(len(drawn), size, replace=False)], rng, int(np.ceil(np.log2(size)))) for _ in range(trees)]
    shared, names = df.sparkSession.sparkContext.broadcast((forest, expected_depth(size))), list(features)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grown, norm = shared.value
        for batch in batches:
            x = batch[names].to_numpy(dtype=np.float64)
            mean = sum(depths(t, x) for t in grown) / len(grown)
            yield pd.DataFrame({key: batch[key], "score": np.power(2.0, -mean / norm)})

    scored = rows.mapInPandas(score, f"{key} {df.schema[key].dataType.simpleString()}, score double")
    bound = scored.agg(F.percentile_approx("score", 1 - share, 10000)).first()[0]  # one number
    return scored.withColumn("anomaly", F.col("score") > bound)
