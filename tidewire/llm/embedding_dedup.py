"""Embedding near-dedup: random-hyperplane signs in several tables, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import Scratch
from tidewire.llm.components import connected_components


def table_shape(rows: int, threshold: float, miss: float, per_bucket: int) -> tuple[int, int]:
    """(bits a table, tables): buckets of about ``per_bucket`` unrelated rows, and so many tables that a pair at the threshold is missed with probability ``miss`` at most."""
    bits = max(6, min(40, math.ceil(math.log2(max(rows, 1) / per_bucket + 1))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-same))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(-1, width)


def _run(x: np.ndarray, signs: np.ndarray, weight: np.ndarray, table: int, side: np.ndarray | None, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Of one bucket, or of two blocks of one (``side`` tells which): links of each row that no
    earlier table finds, and edges that connect what is linked. Work is done in square tiles."""
    total, edges, tile = np.zeros(len(x), dtype=np.int64), [], 1024
    label = np.arange(len(x))
    for a in range(0, len(x), tile):
        for b in range(a, len(x), tile):
            p, q = slice(a, a + tile), slice(b, b + tile)
            near = x[p] @ x[q].T >= threshold
            if side is not None:  # pairs of one block are compared where that block stands alone
                near &= side[p, None] != side[None, q]
            if a == b:
                near = np.triu(near, 1)
            for t in range(table):
                if not near.any():
                    break
                near &= signs[p, t, None] != signs[None, q, t]
            if not near.any():
                continue
            total[p] += (near * weight[None, q]).sum(axis=1)
            total[q] += (near * weight[p, None]).sum(axis=0)
            i, j = np.nonzero(near & (label[p, None] != label[None, q]))
            while len(i):
                u, v = label[i + a], label[j + b]
                high, low = np.maximum(u, v), np.minimum(u, v)
                open_ = high != low
                if not open_.any():
                    break
                i, j, high, low = i[open_], j[open_], high[open_], low[open_]
                # each class that can joins one smaller class, and links within classes fall away
                tops, first = np.unique(high, return_index=True)
                edges += list(zip(tops.tolist(), low[first].tolist()))
                into = np.arange(len(x))
                into[tops] = low[first]
                while (into[into] != into).any():
                    into = into[into]
                label = into[label]
    return total, edges


def _plausible(signs: np.ndarray, codes: np.ndarray, table: int, side: np.ndarray | None, limit: float) -> np.ndarray:
    """Rows of a bucket, or of two blocks of one, with a pair of at most ``limit`` differing signs that no earlier table finds."""
    found, tile, width = np.zeros(len(signs), dtype=bool), 1024, signs.shape[1]
    x = signs.astype(np.float32) * 2 - 1
    for a in range(0, len(x), tile):
        for b in range(a, len(x), tile):
            p, q = slice(a, a + tile), slice(b, b + tile)
            near = x[p] @ x[q].T >= width - 2 * limit
            if side is not None:
                near &= side[p, None] != side[None, q]
            if a == b:
                near = np.triu(near, 1)
            for t in range(table):
                if not near.any():
                    break
                near &= codes[p, t, None] != codes[None, q, t]
            found[p] |= near.any(axis=1)
            found[q] |= near.any(axis=0)
    return found


def _whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 4096) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows in tables that cut no run of equal keys, and the starts of the runs with the end of the last."""

    def with_cuts(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        change = np.zeros(max(len(table) - 1, 0), dtype=bool)
        for c in keys:
            values = table.column(c).to_numpy()
            change |= values[1:] != values[:-1]
        return table, np.flatnonzero(np.concatenate(([True], change, [True])))

    held: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        if len(held) < rows:
            continue
        cut = int(with_cuts(held)[1][-2])
        if cut:
            yield with_cuts(held.slice(0, cut))
            held = held.slice(cut)
    if held is not None and len(held):
        yield with_cuts(held)


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, miss: float = 0.005, per_bucket: int = 64, block: int = 2048, seed: int = 7
) -> DataFrame:
    """(id, n_links, component_id): one row a row of ``vectors``.

    Rows link if the cosine of their vectors, in double precision, is at least ``threshold``. Pairs
    are sought in buckets of equal signs of random hyperplanes, in as many tables as keep the
    chance of missing a pair at the threshold under ``miss``; the cosine of every pair of a bucket
    is computed unless so many of all their signs differ as no pair at the threshold shows (six
    standard deviations), and a pair counts in the first table that has it. Signs alone go to all
    tables; a vector goes to those where one of its pairs counts. Rows of equal vectors are one
    node with a weight, and link with each other. Buckets over ``block`` rows are split: each pair of
    blocks is a task's work of its own, so a hot bucket is no single task and none is capped.

    Vectors of one length are compared with each other, whatever other lengths there are. Vectors
    that are null, empty, zero, or hold null or non-finite components link with nothing: 0 links,
    their own id as component. Null ids are never the smallest of a class, unless it has no other.
    Other columns are not read; no rows give no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embedding-dedup")
    v = F.col(vector_col).cast("array<double>")
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists(v, lambda x: x != 0)
    given = vectors.select(F.col(id_col).alias("id"), F.when(sound, v).alias("v"))
    # -0.0 and 0.0 are one value in a cosine
    given = given.withColumn("v", F.transform("v", lambda x: F.when(x == 0, 0.0).otherwise(x)))
    given = scratch.keep(given.withColumn("node", F.when(F.col("v").isNotNull(), F.md5(F.to_json("v")))), "given")
    nodes = given.where("v is not null").groupBy("node").agg(F.any_value("v").alias("v"), F.count("*").alias("weight"), F.min("id").alias("least"))
    # a node is known by its smallest id first, so the smallest node of a class tells the smallest id
    nodes = scratch.keep(nodes.select(F.struct(F.col("least").isNull().alias("no_id"), "least", F.col("node").alias("key")).alias("node"), F.size("v").alias("width"), "v", "weight"), "nodes")
    bits, tables = table_shape(nodes.count(), threshold, miss, per_bucket)
    node_type = nodes.schema["node"].dataType.simpleString()

    def planes_of(width: int) -> np.ndarray:
        return np.random.default_rng([seed, width]).standard_normal((width, bits * tables))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = 1 << np.arange(bits, dtype=np.int64)
        planes: tuple[int, np.ndarray] = (0, np.zeros((0, 0)))  # of the width at hand
        for batch in batches:
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths).tolist():
                if planes[0] != width:
                    planes = (width, planes_of(width))
                own = batch if (widths == width).all() else batch.filter(pa.array(widths == width))
                for part in (own.slice(at, 2048) for at in range(0, len(own), 2048)):
                    x = np.array(part.column("v").flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, width)
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    x = x / np.linalg.norm(x, axis=1, keepdims=True)
                    above = x @ planes[1] > 0
                    codes = (above.reshape(len(x), tables, bits) * powers).sum(axis=2)
                    unit, signs = [r.tobytes() for r in x.astype("<f8")], [r.tobytes() for r in np.packbits(above, axis=1)]
                    columns = [part.column("node"), part.column("width"), part.column("weight"), pa.array(unit, pa.binary()), pa.array(signs, pa.binary()), pa.array(codes.tolist(), pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(columns, ["node", "width", "weight", "unit", "signs", "codes"])

    def unpacked(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """Signs as 0 and 1, and codes by table."""
        packed = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)
        own = np.unpackbits(packed, axis=1, count=bits * tables)
        return own, own.reshape(len(own), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))

    signed = nodes.mapInArrow(sign, f"node {node_type}, width int, weight long, unit binary, signs binary, codes array<long>")
    signed = scratch.keep(signed.withColumn("key", F.col("node.key")), "signed")
    homes = signed.select("key", "signs", F.posexplode("codes").alias("tab", "code"), "width")
    # few buckets are over a block: at most rows x tables / block
    hot = homes.groupBy("tab", "width", "code").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1")
    homes = homes.join(scratch.keep(hot, "hot"), ["tab", "width", "code"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    # block k meets every block l: it goes to (k, l) for k <= l and (l, k) for l < k
    homes = homes.withColumn("mine", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    homes = homes.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    homes = homes.select("key", "signs", "tab", "width", "code", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), (F.col("mine") > F.col("other")).alias("side"))

    keys = ["tab", "width", "code", "low", "high"]
    differ = math.acos(threshold) / math.pi
    limit = bits * tables * differ + 6 * math.sqrt(bits * tables * differ * (1 - differ))

    def sides(rows: pa.Table, a: int, b: int) -> np.ndarray | None:
        one = rows.column("low")[a].as_py() == rows.column("high")[a].as_py()
        return None if one else rows.column("side").slice(a, b - a).to_numpy().astype(bool)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in _whole_runs(batches, keys):
            tab, goes = rows.column("tab").to_numpy(), np.zeros(len(rows), dtype=bool)
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b - a > 1:
                    own, codes = unpacked(rows.column("signs").slice(a, b - a))
                    goes[a:b] = _plausible(own, codes, int(tab[a]), sides(rows, a, b), limit)
            yield from rows.filter(pa.array(goes)).drop_columns(["signs"]).to_batches()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in _whole_runs(batches, keys):
            tab, width, weight = (rows.column(c).to_numpy() for c in ("tab", "width", "weight"))
            names, units, codes = rows.column("node").combine_chunks(), rows.column("unit"), unpacked(rows.column("signs"))[1]
            who, n, peer = [], [], []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b - a < 2:
                    continue
                x = _matrix(units.slice(a, b - a), int(width[a]))
                own, edges = _run(x, codes[a:b], weight[a:b], int(tab[a]), sides(rows, a, b), threshold)
                for i in np.flatnonzero(own):
                    who.append(a + i), n.append(int(own[i])), peer.append(None)
                for p, q in edges:
                    who.append(a + p), n.append(0), peer.append(a + q)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(who, pa.int64())), pa.array(n, pa.int64()), names.take(pa.array(peer, pa.int64()))], ["node", "n", "peer"])

    near = homes.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(search, "key string, tab int, width int, code long, low int, high int, side boolean")
    near = scratch.keep(near, "near").join(signed.drop("codes", "width"), "key")
    found = near.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(verify, f"node {node_type}, n long, peer {node_type}")
    found = scratch.keep(found, "found")
    links = found.where("n > 0").groupBy("node").agg(F.sum("n").alias("n"))
    classes = connected_components(scratch, found.where("peer is not null").select("node", "peer"))
    named = nodes.select("node", "weight").join(links, "node", "left").join(classes, "node", "left")
    labels = named.select(F.col("node.key").alias("node"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component.least", "node.least").alias("component_id"))
    joined = given.select("id", "node").join(labels, "node", "left")
    single = F.col("n_links").isNull()
    return joined.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(single, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )
