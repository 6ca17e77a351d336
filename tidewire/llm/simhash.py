"""SimHash near-dedup: fingerprints, deletion-variant signatures, connected components; for near copies by shared shingles, an exact check between them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import Scratch, text_key
from tidewire.llm.components import connected_components

#: Runs of equal signatures up to this size are compared pair by pair; longer ones by growing classes.
SMALL_RUN = 12


def simhash(text: str, width: int = 4, seed: int = 42) -> int:
    """64 bits: bit i is 1 if it is set in over half of the hashes of the word shingles, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1])).tolist()
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(64, dtype=np.int64), len(words) - width + 1
    for at in range(0, n, 65536):
        stop = min(n, at + 65536)
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at:stop], (ends[at + width - 1 : stop + width - 1] - 1).tolist(), strict=True)], dtype="<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n, bitorder="little").tobytes(), "little")


def fingerprint(text: Column, width: int = 4, seed: int = 42) -> Column:
    """The SimHash of each whole text as a long (the bits of the unsigned number); null and wordless texts: 0."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t or "", width, seed) for t in texts.tolist()], dtype=np.uint64).view(np.int64))

    return of(text)


def _segments(bits: int) -> list[tuple[int, int]]:
    """(shift, width) of the fewest segments of 64 bits such that, of any ``bits`` differing bits, some segment has one at most."""
    n = bits // 2 + 1
    cuts = [round(64 * i / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _grown(values: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest over links within ``bits`` of one long run: a class grows from its
    first member, and each member is compared with what no class holds yet."""
    out, open_ = [], np.arange(len(values))
    while len(open_):
        front, open_ = [int(open_[0])], open_[1:]
        while front and len(open_):
            at = front.pop()
            near = np.bitwise_count(values[open_] ^ values[at]) <= bits
            joined = open_[near]
            out += [(at, int(j)) for j in joined]
            front += joined.tolist()
            open_ = open_[~near]
    return out


def _links(keys: np.ndarray, values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within equal keys; rows come sorted by key. Runs are connected as all their pairs would be."""
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    sizes = np.diff(edge)
    left, right = [], []
    keep = np.repeat((sizes > 1) & (sizes <= SMALL_RUN), sizes)
    k, v = keys[keep], values[keep]
    for d in range(1, SMALL_RUN):
        hit = (k[d:] == k[:-d]) & (np.bitwise_count(v[d:] ^ v[:-d]) <= bits)
        left.append(v[:-d][hit])
        right.append(v[d:][hit])
    for i in np.flatnonzero(sizes > SMALL_RUN):
        run = np.unique(values[edge[i] : edge[i + 1]])
        if pairs := _grown(run, bits):
            a, b = np.array(pairs).T
            left.append(run[a])
            right.append(run[b])
    return np.concatenate(left), np.concatenate(right)


def near_fingerprints(fingerprints: DataFrame, bits: int = 4) -> DataFrame:
    """(a, b): links between distinct fingerprints (long column ``fp``) of at most ``bits`` differing bits, enough to connect all that are linked.

    64 bits are cut into ``bits // 2 + 1`` segments, so that one of them differs in one bit at most.
    Each fingerprint is indexed under every segment with every one of its bits deleted (64 keys);
    two fingerprints whose segment differs in at most that bit meet there, and are compared whole.
    """
    cuts = _segments(bits)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fp), 4096):
                own, rows = fp[at : at + 4096], []
                for shift, width in cuts:
                    part = (own >> np.uint64(shift)) & np.uint64((1 << width) - 1)
                    for i in range(width):
                        low = part & np.uint64((1 << i) - 1)
                        high = (part >> np.uint64(i + 1)) << np.uint64(i)
                        # the key says which bit is deleted and what the others are
                        rows.append((np.uint64(shift + i) << np.uint64(40)) | high | low)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows).view(np.int64)), pa.array(np.tile(own, 64).view(np.int64))], ["key", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_v = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(k: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            a, b = _links(k, v, bits)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, i].copy().view(np.int64)) for i in (0, 1)], ["a", "b"])

        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if sum(len(x) for x in waiting) < 200_000:
                continue
            k = np.concatenate([held_k, *[x.column(0).to_numpy(zero_copy_only=False) for x in waiting]])
            v = np.concatenate([held_v, *[x.column(1).to_numpy(zero_copy_only=False).view(np.uint64) for x in waiting]])
            waiting = []
            cut = int(np.searchsorted(k, k[-1], "left"))  # the last key may go on in the next batch
            held_k, held_v = k[cut:], v[cut:]
            if cut:
                yield out(k[:cut], v[:cut])
        k = np.concatenate([held_k, *[x.column(0).to_numpy(zero_copy_only=False) for x in waiting]])
        v = np.concatenate([held_v, *[x.column(1).to_numpy(zero_copy_only=False).view(np.uint64) for x in waiting]])
        if len(k):
            yield out(k, v)

    keyed = fingerprints.select("fp").mapInArrow(index, "key long, fp long")
    spread = keyed.repartition("key").sortWithinPartitions("key")
    return spread.mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, bits: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp, component_id): one row a row of ``docs``; fp is the fingerprint as a long.

    Texts link if their fingerprints differ in at most ``bits`` bits; component_id is the smallest id
    reachable by links, the row's own included. Rows of equal fingerprints are one node, so copies
    cost no pairs. Null and wordless texts have fingerprint zero and link like any other. Null ids
    are never the smallest, unless a class has no other (then null). Other columns are not read.
    No rows give no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.keep(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), width, seed).alias("fp")), "marked")
    # a node is known by its smallest id first, so the smallest node of a class tells the smallest id
    nodes = scratch.keep(marked.groupBy("fp").agg(F.min("id").alias("least")).select("fp", F.struct(F.col("least").isNull().alias("no_id"), "least", "fp").alias("node")), "nodes")
    pairs = near_fingerprints(nodes, bits)
    for end in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("fp").alias(end), F.col("node").alias(f"node_{end}")), end)
    classes = connected_components(scratch, pairs.select("node_a", "node_b")).select(F.col("node.fp").alias("fp"), "component")
    labels = nodes.join(classes, "fp", "left").select("fp", F.coalesce("component.least", "node.least").alias("component_id"))
    return marked.join(labels, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def shingles(text: str, width: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted hashes of the distinct word shingles of a text; a text of fewer words has one, a wordless text none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    n = max(1, len(words) - width + 1)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), seed) for i in range(n)), dtype=np.uint64, count=n))


#: A round of similar_texts: two words of 64 bits, cut into segments of 16.
WORDS, PARTS, PART = 2, 8, 16
#: Runs of equal keys up to this size are compared pair by pair, longer ones from rows that have met no other yet.
MANY = 256
#: Nodes that whole segments connect are a crowd, if so many (at least, at most), and are compared by blocks of the crowd; all
#: other candidates are compared where they meet by keys.
CROWD = (16, 1 << 16)


def set_simhashes(sets: list[np.ndarray], words: int, seed: int = 42) -> np.ndarray:
    """SimHash of ``words`` times 64 bits (a row a set) over sets of sorted shingle hashes, none empty: each bit is 1 if set in over half
    of the hashes that the shingles have for its word."""
    salts = np.random.default_rng(seed).integers(0, 1 << 63, words, dtype=np.uint64)
    out, lanes = [np.zeros((0, words), dtype="<u8")], np.uint64(0x0101010101010101)
    if not sets:
        return out[0]
    blocks = np.cumsum([len(g) for g in sets]) // 8192
    for block in np.split(np.arange(len(sets)), np.flatnonzero(np.diff(blocks)) + 1):
        own = [sets[i] for i in block]
        sizes = np.array([len(g) for g in own])
        pieces = -(-sizes // 255)  # bytes hold sums of up to 255
        first = np.cumsum(pieces) - pieces
        starts = np.repeat(np.cumsum(sizes) - sizes, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
        h = np.concatenate(own)[:, None] ^ salts
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h ^= h >> np.uint64(shift)
            h *= np.uint64(factor)
        h ^= h >> np.uint64(31)
        total = np.stack([np.add.reduceat((h >> np.uint64(bit)) & lanes, starts, axis=0) for bit in range(8)], axis=-1)  # piece, word, bit of a byte
        total = np.add.reduceat(total.view(np.uint8).reshape(*total.shape, 8), first, axis=0, dtype=np.int64).transpose(0, 1, 3, 2)
        ones = total * 2 > sizes[:, None, None, None]
        out.append(np.packbits(ones.reshape(len(own), words, 64), axis=2, bitorder="little").view("<u8").reshape(len(own), words))
    return np.concatenate(out)


def _reach(bits: int, similarity: float, deviations: float) -> int:
    """Bits of ``bits`` that differ at most between sets of ``similarity``: a quarter over what is expected, as small sets differ more, and so many standard deviations."""
    share = min(0.5, 1.25 * np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(bits * share + deviations * (bits * share * (1 - share)) ** 0.5)


def _place(differ: np.ndarray, reach: int) -> np.ndarray:
    """Where pairs of fingerprints meet first, by the bits in which they differ (a row a pair, two words a round): the number
    of the deleted bit, of the first segment with one differing bit at most in a round in which ``reach`` bits differ at most; -1: nowhere."""
    out = np.full(len(differ), -1, dtype=np.int64)
    for k in reversed(range(differ.shape[1] // WORDS)):
        near = np.bitwise_count(differ[:, k * WORDS : (k + 1) * WORDS]).sum(axis=1, dtype=np.int64) <= reach
        for j in reversed(range(PARTS)):
            part = (differ[:, k * WORDS + j * PART // 64] >> np.uint64(j * PART % 64)) & np.uint64((1 << PART) - 1)
            bit = np.where(part > 0, np.bitwise_count(part - np.uint64(1)), 0).astype(np.int64)  # of a part with one bit
            out = np.where(near & (np.bitwise_count(part) <= 1), (k * PARTS + j) * PART + bit, out)
    return out


def _deletions(words: np.ndarray, k: int) -> np.ndarray:
    """The keys of round k, one column a deleted bit: the number of the bit, and what else its segment says."""
    out = []
    for j in range(PARTS):
        part = (words[:, j * PART // 64] >> np.uint64(j * PART % 64)) & np.uint64((1 << PART) - 1)
        for i in range(PART):
            rest = (part >> np.uint64(i + 1)) << np.uint64(i) | part & np.uint64((1 << i) - 1)
            out.append(np.uint64(((k * PARTS + j) * PART + i) << 40) | rest)
    return np.stack(out, axis=1).view(np.int64)


def _whole_keys(batches: Iterator[pa.RecordBatch], rows: int = 200_000) -> Iterator[pa.Table]:
    """Rows sorted by their column ``key``, as tables of whole keys."""
    held, fresh = [], 0
    for batch in batches:
        held.append(batch)
        fresh += len(batch)
        if fresh < rows:
            continue
        now, fresh = pa.Table.from_batches(held), 0
        key = now.column("key").to_numpy()
        if cut := int(np.searchsorted(key, key[-1], "left")):  # the last key may go on in the next batch
            yield now.slice(0, cut)
            held = now.slice(cut).combine_chunks().to_batches()
    if held and len(now := pa.Table.from_batches(held)):
        yield now


def _crowded(key: np.ndarray, marks: np.ndarray, far: int) -> list[tuple[int, int]]:
    """Edges that connect rows of one key within ``far``: each row to the first of those left that it is near; rows come sorted by key."""
    edge, out = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True]))), []
    sizes = np.diff(edge)
    ends, first, some = np.repeat(edge[1:], sizes), np.repeat(np.arange(len(sizes)), sizes), sizes > SMALL_RUN
    at, step = np.flatnonzero(np.repeat(~some, sizes)), 1
    while len(at := at[at + step < ends[at]]):  # most short runs have no such rows
        some[first[at[np.bitwise_count(marks[at] ^ marks[at + step]).sum(axis=1, dtype=np.int64) <= far]]] = True
        step += 1
    for r in np.flatnonzero(some).tolist():
        left = np.arange(edge[r], edge[r + 1])
        while len(left) > 1:
            near = np.bitwise_count(marks[left] ^ marks[left[0]]).sum(axis=1, dtype=np.int64) <= far
            out += [(int(left[0]), j) for j in left[near][1:].tolist()]
            left = left[~near]
    return out


def _company(key: np.ndarray, words: np.ndarray, reach: int, crowd: np.ndarray | None = None) -> np.ndarray:
    """Which rows have another of their key within ``reach``, not of their own crowd (0: of none); rows come sorted by key. Pairs of
    short runs count where they meet first, those of long runs wherever the deleted bit tells them apart (or is a segment's first)."""
    crowd = np.zeros(len(key), dtype=np.int64) if crowd is None else crowd
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    sizes, met = np.diff(edge), np.zeros(len(key), dtype=bool)
    ends, at, step = np.repeat(edge[1:], sizes), np.flatnonzero(np.repeat((sizes > 1) & (sizes <= MANY), sizes)), 1
    own = (key >> 40) % (PARTS * PART)
    while len(at := at[at + step < ends[at]]):
        differ = words[at] ^ words[at + step]
        near = np.flatnonzero((np.bitwise_count(differ).sum(axis=1, dtype=np.int64) <= reach) & ~(met[at] & met[at + step]))
        bit = own[at[near]]
        told = (differ[near, bit // 64] >> (bit % 64).astype(np.uint64)) & np.uint64(1)
        apart = (crowd[at[near]] == 0) | (crowd[at[near]] != crowd[at[near] + step])
        near = near[apart & ((told > 0) | (bit % PART == 0))]
        first = at[near][_place(differ[near], reach) == own[at[near]]]
        met[first] = met[first + step] = True
        step += 1
    for r in np.flatnonzero(sizes > MANY):
        run, of, bit = words[edge[r] : edge[r + 1]], crowd[edge[r] : edge[r + 1]], int(own[edge[r]])
        tell = (run[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)
        if bit % PART and (tell == tell[0]).all() or of[0] and (of == of[0]).all():
            continue
        found = np.zeros(len(run), dtype=bool)
        for i in np.argsort(tell != (2 * tell.sum() < len(tell))).tolist():  # the rarer bit's rows find the others at once
            if found[i]:
                continue
            near = np.bitwise_count(run ^ run[i]).sum(axis=1, dtype=np.int64) <= reach
            near = near & (tell != tell[i]) if bit % PART else near
            near = near & (of != of[i]) if of[i] else near
            near[i] = False
            found |= near
            found[i] = near.any()
        met[edge[r] : edge[r + 1]] = found
    return met


def _joined(grams: list[np.ndarray], marks: np.ndarray, key: int, label: np.ndarray, side: np.ndarray | None, similarity: float, reach: int, far: int) -> list[tuple[int, int]]:
    """Edges that connect, across the classes of ``label``, the similar ones among the nodes of one key or crowd (below zero), or of
    two blocks of one (``side`` tells which). A pair of a key is compared where its fingerprints (``marks``) meet first;
    a node's shingles are marked once and counted in all others."""
    n, edges = len(grams), []
    sizes = np.array([len(g) for g in grams])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    _, ids = np.unique(np.concatenate(grams), return_inverse=True)
    mark, label = np.zeros(ids.max() + 1, dtype=bool), label.copy()
    for i in range(n - 1):
        may = label[i + 1 :] != label[i]
        if side is not None:
            may &= side[i + 1 :] != side[i]
        may &= np.minimum(sizes[i + 1 :], sizes[i]) >= similarity * np.maximum(sizes[i + 1 :], sizes[i])
        others = np.flatnonzero(may) + i + 1
        differ = marks[others] ^ marks[i]
        near = np.bitwise_count(differ).sum(axis=1, dtype=np.int64) <= far
        others = others[near & (_place(differ, reach) == key >> 40) if key >= 0 else near]
        if not len(others):
            continue
        mark[ids[starts[i] : starts[i] + sizes[i]]] = True
        if len(others) > n // 8:
            both = np.add.reduceat(mark[ids], starts, dtype=np.int64)[others]
        else:
            both = np.array([mark[ids[starts[j] : starts[j] + sizes[j]]].sum() for j in others.tolist()])
        mark[ids[starts[i] : starts[i] + sizes[i]]] = False
        for j in others[both >= similarity * (sizes[i] + sizes[others] - both)].tolist():
            if label[j] != label[i]:
                edges.append((i, j))
                label[label == label[j]] = label[i]
    return edges


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, rounds: int = 4, seed: int = 42, block: int = 1024) -> DataFrame:
    """(id, text_key, root): one row a row of ``docs``; texts of one root are linked by pairs whose sets of word shingles have a Jaccard similarity of ``similarity`` or more.

    Texts of equal sets are one node. A node has a SimHash of 128 bits for each of ``rounds``. Its eight
    segments of 16 bits are indexed with every one of their bits deleted, so nodes meet that differ
    in one bit of a segment at most; candidates are those that meet and differ in few bits in all (a
    pair at 0.8 is none in four rounds with a chance of 0.00003, one of four and five shingles of
    0.003). Every candidate pair between classes is compared by all its shingles, unless its
    fingerprints of all rounds put it far below ``similarity``.
    In a crowd of texts that are alike, but less than ``similarity``, a node would meet others at most of
    its keys. So crowds are sought first, as what equal whole segments connect: all pairs of a crowd are
    candidates, and its nodes have one row each for it; keys are left to pairs that no crowd holds.
    A key's (or crowd's) nodes are first compared with two drawn from them, so that a large group of near copies is
    one class, then across the classes that are left: in one task for each key, and for each pair of
    blocks of a key of more than ``block`` nodes. Only edges between classes come out of a task, never
    pairs; no group is capped.
    """
    scratch = Scratch(docs.sparkSession, "similar")
    reach, far = _reach(64 * WORDS, similarity, 2.6), _reach(64 * WORDS * rounds, similarity, 5)
    few = max(0, similarity / max(1e-9, 1 - similarity) - 1e-6)  # smaller sets are similar to their equals alone

    @F.pandas_udf("struct<node:binary,sketch:binary>")
    def sketched(texts: pd.Series) -> pd.DataFrame:
        sets = [shingles(t or "", width, seed) for t in texts.tolist()]
        marks = iter(set_simhashes([g for g in sets if len(g) > few], WORDS * rounds, seed))
        return pd.DataFrame({"node": [xxhash.xxh3_128_digest(g.tobytes()) for g in sets], "sketch": [next(marks).tobytes() if len(g) > few else None for g in sets]})

    @F.pandas_udf("binary")
    def grams_of(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t or "", width, seed).tobytes() for t in texts.tolist()])

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        differ = np.frombuffer(b"".join(a), "<u8") ^ np.frombuffer(b"".join(b), "<u8")
        return pd.Series(np.bitwise_count(differ).reshape(len(a), -1).sum(axis=1, dtype=np.int64) <= far)

    @F.pandas_udf("double")
    def jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both / (len(x) + len(y) - both))
        return pd.Series(out, dtype=float)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), "<u8").reshape(len(batch), -1)
            for j in range(PARTS * rounds):
                part = (words[:, j * PART // 64] >> np.uint64(j * PART % 64)) & np.uint64((1 << PART) - 1)
                key = pa.array((part | np.uint64(j << PART)).view(np.int64))
                yield pa.RecordBatch.from_arrays([key, batch.column("node"), batch.column("sketch")], ["key", "node", "sketch"])

    def crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now in _whole_keys(batches):
            marks = np.frombuffer(b"".join(now.column("sketch").to_pylist()), "<u8").reshape(len(now), -1)
            if edges := _crowded(now.column("key").to_numpy(), marks, far):
                names = now.column("node").combine_chunks()
                yield pa.RecordBatch.from_arrays([names.take(pa.array([e[k] for e in edges])) for k in (0, 1)], ["a", "b"])

    def indexed(k: int):
        def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words = np.frombuffer(b"".join(batch.column("mark").to_pylist()), "<u8").reshape(-1, WORDS)
                crowd = batch.column("crowd").to_numpy()
                for at in range(0, len(words), 2048):
                    keys = _deletions(own := words[at : at + 2048], k)
                    columns = [keys.ravel(), *(np.repeat(c, keys.shape[1]) for c in (*own.view(np.int64).T, crowd[at : at + 2048]))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "w0", "w1", "crowd"])

        return index

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now in _whole_keys(batches):
            key, crowd = (now.column(c).to_numpy() for c in ("key", "crowd"))
            words = np.stack([now.column(c).to_numpy().view(np.uint64) for c in ("w0", "w1")], axis=1)
            met = _company(key, words, reach, crowd)
            yield pa.RecordBatch.from_arrays([pa.array(key[met]), pa.array([w.tobytes() for w in words[met]], pa.binary()), pa.array(crowd[met])], ["key", "mark", "crowd"])

    text = F.col(text_col)
    made = docs.select(F.col(id_col).alias("id"), text_key(text).alias("text_key"), sketched(text).alias("s"))
    marked = scratch.keep(made.select("id", "text_key", "s.node", "s.sketch"), "marked")
    distinct = scratch.keep(marked.where("sketch is not null").groupBy("node").agg(F.min("text_key").alias("text_key"), F.any_value("sketch").alias("sketch")), "distinct")
    spread = distinct.select("node", "sketch").mapInArrow(segments, "key long, node binary, sketch binary").repartition("key").sortWithinPartitions("key", "node")
    crowds = connected_components(scratch, spread.mapInArrow(crowded, "a binary, b binary"), "cc-crowd")
    sizes = crowds.groupBy("component").count().where(F.col("count").between(*CROWD))
    # below zero, as no key is
    crowds = crowds.join(sizes, "component").select("node", F.xxhash64("component").bitwiseOR(F.lit(-(1 << 63))).alias("crowd"))
    nodes = scratch.keep(distinct.join(crowds, "node", "left").withColumn("crowd", F.coalesce("crowd", F.lit(0).cast("long"))), "nodes")
    shared = nodes.where("crowd < 0").select(F.col("crowd").alias("key"), "node")
    for k in range(rounds):
        of_round = nodes.select("node", F.substring("sketch", 8 * WORDS * k + 1, 8 * WORDS).alias("mark"), "crowd")
        spread = of_round.select("mark", "crowd").mapInArrow(indexed(k), "key long, w0 long, w1 long, crowd long").repartition("key").sortWithinPartitions("key")
        met = scratch.keep(spread.mapInArrow(meet, "key long, mark binary, crowd long").distinct(), f"met-{k}")
        shared = shared.union(met.join(of_round, ["mark", "crowd"]).select("key", "node"))
    shared = scratch.keep(shared, "shared")
    need = nodes.join(shared.select("node").distinct(), "node")
    said = docs.select(text_key(text).alias("text_key"), text.alias("said")).join(need, "text_key").dropDuplicates(["text_key"])
    held = scratch.keep(said.select("node", "sketch", grams_of("said").alias("grams")), "held")

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        """Those of the pairs (a, b) that are similar."""

        def beside(df: DataFrame, column: str) -> DataFrame:
            for end in ("a", "b"):
                df = df.join(held.select(F.col("node").alias(end), F.col(column).alias(f"{column}_{end}")), end)
            return df

        ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        close = scratch.keep(beside(ordered, "sketch").where(alike("sketch_a", "sketch_b")).select("a", "b"), f"close-{name}")
        return scratch.keep(beside(close, "grams").where(jaccard("grams_a", "grams_b") >= similarity).select("a", "b"), f"links-{name}")

    place = ["key", "low", "high"]

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            key, low, high = (table.column(c).to_numpy() for c in place)
            cuts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]), [True])))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if b - a < 2:
                    continue
                own = table.slice(a, b - a).combine_chunks()
                grams = [np.frombuffer(x.as_buffer(), np.uint64) for x in own.column("grams")]
                marks = np.frombuffer(b"".join(own.column("sketch").to_pylist()), "<u8").reshape(b - a, -1)
                label = own.column("root").combine_chunks().dictionary_encode().indices.to_numpy()
                side = own.column("side").to_numpy(zero_copy_only=False).astype(bool) if low[a] != high[a] else None
                if edges := _joined(grams, marks, int(key[a]), label, side, similarity, reach, far):
                    names = own.column("node").combine_chunks()
                    yield pa.RecordBatch.from_arrays([names.take(pa.array([e[k] for e in edges])) for k in (0, 1)], ["a", "b"])

        waiting: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            waiting = now if waiting is None else pa.concat_tables([waiting, now])
            if not len(waiting):
                continue
            same = np.logical_and.reduce([waiting.column(c).to_numpy() == waiting.column(c)[len(waiting) - 1].as_py() for c in place])
            if cut := int(np.argmax(same)):  # the last group may go on
                yield from out(waiting.slice(0, cut))
                waiting = waiting.slice(cut)
        if waiting is not None and len(waiting):
            yield from out(waiting)

    def linked_across(members: DataFrame) -> DataFrame:
        """Edges between the classes of a key's nodes, dealt to ``blocks``; block k meets every block l in (least, greatest) of the two."""
        dealt = members.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("key", "node", "root", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), (F.col("mine") > F.col("other")).alias("side"))
        dealt = dealt.join(held.select("node", "sketch", "grams"), "node").repartition(*place).sortWithinPartitions(*place)
        return scratch.keep(dealt.mapInArrow(across, "a binary, b binary"), "links-rest")

    members, links = shared.withColumn("root", F.col("node")), None
    for step in ("first", "second", "rest"):
        if step == "rest":
            found = linked_across(members)
        else:
            drawn = members.groupBy("key").agg(F.min_by(F.struct("node", "root"), F.xxhash64(F.lit(step), "node")).alias("d"))
            pairs = members.join(drawn, "key").where("root != d.root").select(F.col("node").alias("a"), F.col("d.node").alias("b"))
            found = linked(pairs, step)
        links = found if links is None else links.union(found)
        classes = connected_components(scratch, links, f"cc-{step}")
        if step != "rest":
            named = shared.join(classes, "node", "left").select("key", "node", F.coalesce("component", "node").alias("root"))
            seen = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count("*") / block).cast("int").alias("blocks"))
            open_ = seen.where("low != high").select("key", "blocks")
            members = scratch.keep(named.join(open_, "key"), f"members-{step}")
    return marked.join(classes, "node", "left").select("id", "text_key", F.coalesce("component", "node").alias("root"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``docs`` for each class of similar_texts, that of the smallest id (of its texts, the one of the smallest key), all columns kept.

    Rows that repeat an id and a text stay once, rows that repeat an id with unlike texts stay for
    each. A row with a null id stays only where its class has no other.
    """
    found = similar_texts(docs, id_col, text_col, **options)
    stay_id, stay_text = (f"_{uuid.uuid4().hex}" for _ in range(2))  # names that no column of docs has
    least = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", F.col("text_key").isNull(), "text_key")).alias("least"))
    least = least.select(F.col("least.id").alias(stay_id), F.col("least.text_key").alias(stay_text)).distinct()
    same = F.col(id_col).eqNullSafe(F.col(stay_id)) & text_key(F.col(text_col)).eqNullSafe(F.col(stay_text))
    return docs.join(least, same, "left_semi").dropDuplicates([id_col, text_col])
