"""Exact cosine top-k of a query set against all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.session import saved

def cosine_top_k(rows: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int, block: int = 10_000) -> DataFrame:
    """(query, id, similarity, rank): the ``k`` rows nearest to each query by cosine, rounded to 6 digits; ties by id.

    Queries come in blocks of about ``block``, by a hash of their id; each block is collected, broadcast
    and held against all rows. Each task keeps the ``k`` best of its rows for each query, so k rows a
    task and query are shuffled. Vectors are held against those of the same length alone. Null ids and vectors
    are left out, zero vectors score 0, and those with null or non-finite components are near to nothing.
    A block's result is written before the next block begins, and its broadcast goes.
    """
    whole = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()
    rows, asked = rows.where(whole).select(id_col, vector_col), queries.where(whole).select(id_col, vector_col)
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"query {kind}, id {kind}, similarity double"
    blocks = max(1, -(-asked.count() // block))
    found = None
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64(id_col), F.lit(blocks)) == b).toPandas()  # about a block of rows
        if own.empty:
            continue
        sought = rows.sparkSession.sparkContext.broadcast(_by_width(own[id_col], own[vector_col]))
        part = saved(rows.mapInPandas(_nearest(sought, id_col, vector_col, k), schema))
        sought.unpersist()
        found = part if found is None else found.union(part)
    if found is None:
        found = rows.sparkSession.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _names(ids: pd.Series) -> np.ndarray:
    """Ids as an array that numpy can sort."""
    return ids.to_numpy(dtype=str) if ids.dtype == object else ids.to_numpy()


def _by_width(ids: pd.Series, values: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors, their ids and the vectors at length one."""
    out, names, widths = {}, _names(ids), np.array([len(v) for v in values], dtype=np.int64)
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        x = np.array([np.asarray(values.iloc[i], dtype=np.float64) for i in at]).reshape(len(at), width)
        n = np.linalg.norm(x, axis=1, keepdims=True)
        out[width] = (names[at], x / np.where(n == 0, 1, n))
    return out


def _nearest(sought, id_col: str, vector_col: str, k: int):
    """A pass over batches of rows that keeps the ``k`` nearest rows of a task to each query of one block."""

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, held = sought.value, {}
        most = max(len(names) for names, _ in asked.values())
        tile = max(k, 2_000_000 // most)
        for batch in (whole.iloc[a : a + tile] for whole in batches for a in range(0, len(whole), tile)):
            for width, (own, x) in _by_width(batch[id_col], batch[vector_col]).items():
                if width not in asked:
                    continue
                names, q = asked[width]
                got = np.round(q @ x.T, 6)
                near = np.where(np.isfinite(got) & (own[None, :] != names[:, None]), got, -np.inf)  # not itself
                ids = np.broadcast_to(own, near.shape)
                if width in held:
                    ids, near = np.concatenate([held[width][0], ids], axis=1), np.concatenate([held[width][1], near], axis=1)
                order = np.lexsort((ids, -near), axis=1)[:, :k]
                held[width] = (np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1))
        for width, (ids, near) in held.items():
            fine = np.isfinite(near)
            yield pd.DataFrame({"query": np.broadcast_to(asked[width][0][:, None], ids.shape)[fine], "id": ids[fine], "similarity": near[fine]})

    return best
