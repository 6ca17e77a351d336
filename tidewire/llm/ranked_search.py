"""Ranked lexical search: an index of document intervals, searched best first under range-maximum bounds."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidewire.llm.common import Scratch, text_of

#: The characters of terms, as a class of characters and as UTF-8 bytes (those of other characters all have the high bit).
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The share of a document's length in its norm, in hundredths, and the scale of impacts.
SHARE, WHOLE, SCALE = 90, 100, 1_000_000_000


def terms_of(text: Column) -> Column:
    """The terms of a text column, in order; null has none."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))


def _id_order(value) -> tuple:
    """Sorts ids as Spark does, null first."""
    return (value is not None, value)


def _segment(ids: list, texts: list[str]) -> tuple:
    """One row of the index: its documents in order of their ids, and each term's places among them with its counts."""
    order = sorted(range(len(ids)), key=lambda i: _id_order(ids[i]))
    words = [TERM_BYTES.findall(texts[i].encode("utf-8", "surrogatepass").lower()) for i in order]
    sizes = np.array([len(x) for x in words], dtype=np.int64)
    flat = np.empty(int(sizes.sum()), dtype=object)
    flat[:] = [w for own in words for w in own]
    codes, terms = pd.factorize(flat) if len(flat) else (np.zeros(0, dtype=np.int64), [])
    pairs, counts = np.unique(codes * len(ids) + np.repeat(np.arange(len(ids)), sizes), return_counts=True)
    first = np.searchsorted(pairs, np.arange(len(terms) + 1) * len(ids))
    return (
        [ids[i] for i in order], sizes, int((sizes > 0).sum()), int(sizes.sum()), [t.decode("utf-8", "surrogatepass") for t in terms],
        np.diff(first), (pairs % max(1, len(ids))).astype(np.int32), counts.astype(np.int32),
    )


def build_index(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", segment_chars: int = 4_000_000, segment_docs: int = 20_000, name: str = "index") -> DataFrame:
    """The index of all rows of ``docs``, written as a table of segments; no shuffle.

    A row is a segment: an interval of documents in order of their ids (null ids first), cut where it has about
    ``segment_chars`` characters or ``segment_docs`` rows. A longer text is a segment of its own, whole.
    Columns: ids and sizes (terms with repeats) of the documents, n_docs (those with a term), n_terms,
    terms, and for each term its number of documents (df), their places and counts.
    """
    own = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    schema = StructType.fromDDL(f"ids array<{kind}>, sizes array<long>, n_docs long, n_terms long, terms array<string>, df array<long>, places array<int>, counts array<int>")
    types = to_arrow_schema(schema).types

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(_segment(ids, texts), types)], names=schema.names)

        ids, texts, held = [], [], 0
        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if texts and (held + len(text) > segment_chars or len(texts) >= segment_docs):
                    yield row()
                    ids, texts, held = [], [], 0
                ids.append(id_)
                texts.append(text)
                held += len(text)
        if texts:
            yield row()

    return scratch.keep(own.mapInArrow(built, schema), name)


@dataclass
class RangeMaxima:
    """Sparse tables over the posting lists of the asked terms in one segment, all lists behind one another.

    ``tables[k][i]`` is the place of the greatest impact among the 2**k postings from i on, the first of equals.
    """

    n_docs: int
    first: np.ndarray  # where each list begins; one entry more at the end
    places: np.ndarray
    impacts: np.ndarray
    tables: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.keys = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first)) * self.n_docs + self.places
        level, size = np.arange(len(self.places)), 1
        self.tables = [level]
        while 2 * size <= np.diff(self.first).max(initial=0):
            left, right = level[:-size], level[size:]
            level = np.where(self.impacts[left] >= self.impacts[right], left, right)
            self.tables.append(level)
            size *= 2
        # all levels as one array: they get shorter by the size of their window
        self.offsets = np.r_[0, np.cumsum([len(x) for x in self.tables])]
        self.flat = np.concatenate(self.tables)
        self.impacts_or_none = np.r_[self.impacts, 0]

    def greatest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place of the greatest impact in each range of postings [a, b); the place behind all where it is empty."""
        n = b - a
        some = n > 0
        k = np.frexp(np.maximum(n, 1))[1] - 1
        at = self.offsets[k]
        left = self.flat[np.where(some, at + a, 0)]
        right = self.flat[np.where(some, at + b - (1 << k), 0)]
        best = np.where(self.impacts[left] >= self.impacts[right], left, right)
        return np.where(some, best, len(self.impacts))


class Top:
    """The k best documents so far of one item: greater scores first, then smaller ids."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def add(self, score: int, id_: tuple) -> None:
        if len(self.rows) < self.k or (-score, id_) < self.rows[-1]:
            self.rows = sorted([*self.rows, (-score, id_)])[: self.k]

    def least(self) -> tuple | None:
        return self.rows[-1] if len(self.rows) == self.k else None


def best_first(lists: RangeMaxima, terms: np.ndarray, weights: np.ndarray, ids: list, top: Top, at_once: int = 32) -> int:
    """Adds to ``top`` all documents of a segment that belong there; gives the number of documents scored.

    An interval of documents is bounded by the sum over the item's terms of weight times the greatest
    impact in it. The intervals with the greatest bounds, ``at_once`` of them at a time, are split at the document
    that has the greatest single term; it is scored, and both sides are bounded anew. It ends when no
    interval can hold a document that comes before the last of ``top``: none has a greater bound, or
    the same one and a smaller id.
    """

    def bounded(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = lists.greatest(a, b)
        worth = weights * lists.impacts_or_none[at]
        return worth.sum(axis=1), np.minimum(at[np.arange(len(at)), worth.argmax(axis=1)], len(lists.places) - 1)

    a, b = lists.first[terms][None, :], lists.first[terms + 1][None, :]
    low = np.zeros(1, dtype=np.int64)
    bound, split = bounded(a, b)
    scored = 0
    while True:
        least = top.least()
        open_ = bound > (0 if least is None else -least[0])
        if least is not None:
            for i in np.flatnonzero(bound == -least[0]):
                open_[i] = bound[i] > 0 and _id_order(ids[low[i]]) < least[1]
        if not open_.any():
            return scored
        if not open_.all():
            a, b, low, bound, split = a[open_], b[open_], low[open_], bound[open_], split[open_]
        if len(bound) > at_once:
            best = np.argpartition(-bound, at_once)
            now, later = best[:at_once], best[at_once:]
        else:
            now, later = np.arange(len(bound)), np.zeros(0, dtype=np.int64)
        doc = lists.places[split[now]].astype(np.int64)
        here = np.searchsorted(lists.keys, terms[None, :] * lists.n_docs + doc[:, None])
        has = (here < b[now]) & (lists.keys[np.minimum(here, len(lists.keys) - 1)] == terms[None, :] * lists.n_docs + doc[:, None])
        scores = np.where(has, weights * lists.impacts_or_none[here], 0).sum(axis=1)
        scored += len(doc)
        for d, score in zip(doc.tolist(), scores.tolist()):
            if score > 0 and (least is None or score >= -least[0]):
                top.add(score, _id_order(ids[d]))
        new_a, new_b = np.concatenate([a[now], here + has]), np.concatenate([here, b[now]])
        new_low = np.concatenate([low[now], doc + 1])
        new_bound, new_split = bounded(new_a, new_b)
        a, b, low = np.concatenate([a[later], new_a]), np.concatenate([b[later], new_b]), np.concatenate([low[later], new_low])
        bound, split = np.concatenate([bound[later], new_bound]), np.concatenate([split[later], new_split])


@dataclass
class Asked:
    """A block of items: their terms and weights, and what norms take from the whole index."""

    items: list
    terms: list[str]
    of_item: list[tuple[np.ndarray, np.ndarray]]
    n_docs: int
    n_terms: int

    def search(self, segment: dict, tops: list[Top]) -> int:
        """Searches one segment for all items."""
        at = pd.Index(segment["terms"]).get_indexer(self.terms) if segment["terms"] else np.full(len(self.terms), -1)
        known = np.flatnonzero(at >= 0)
        if not len(known):
            return 0
        df = np.asarray(segment["df"])
        first = np.r_[0, np.cumsum(df)]
        own = np.concatenate([np.arange(first[t], first[t + 1]) for t in at[known]])
        places, counts = np.asarray(segment["places"])[own], np.asarray(segment["counts"])[own].astype(np.int64)
        norms = WHOLE - SHARE + SHARE * np.asarray(segment["sizes"], dtype=np.int64) * self.n_docs // self.n_terms
        impacts = SCALE * counts // (1000 * counts + 8 * norms[places])
        lists = RangeMaxima(len(segment["ids"]), np.r_[0, np.cumsum(df[at[known]])], places, impacts)
        local = np.full(len(self.terms), -1)
        local[known] = np.arange(len(known))
        scored = 0
        for (terms, weights), top in zip(self.of_item, tops):
            have = local[terms]
            if (have >= 0).any():
                scored += best_first(lists, have[have >= 0], weights[have >= 0], segment["ids"], top)
        return scored


@contextmanager
def _few_rows_at_once(spark: SparkSession, rows: int = 4):
    """Segments are large rows: readers and Python workers hold few of them at once."""
    names = ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name in names:
            spark.conf.set(name, str(rows))
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def search(index: DataFrame, items: DataFrame, scratch: Scratch, item_col: str = "item_id", item_text: str = "text", id_name: str = "doc_id", k: int = 10, block_terms: int = 200_000) -> DataFrame:
    """(item, rank, doc id, score): the ``k`` best rows of ``index`` for each item of ``items``, exactly.

    Rows of one item id, null included, are one item with the terms of all its texts. Only documents
    with a score above 0 count; equal scores go by ascending doc id, null ids first, and rows that
    share an id have a rank each. Items without terms, terms that no document has, and an empty index
    give no rows. Items are searched in blocks of about ``block_terms`` of their terms (an item's terms stay
    together), and only a block reaches the driver and is broadcast. A task holds its best ``k`` of
    each item over all its segments, whose last score bounds the later ones; only these are shuffled.
    """
    spark = index.sparkSession
    total = index.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_terms").alias("n_terms")).first()
    asked = items.select(F.col(item_col).alias("item"), F.explode(F.array_distinct(terms_of(F.col(item_text)))).alias("term")).distinct()
    item_kind, id_kind = asked.schema["item"].dataType.simpleString(), index.schema["ids"].dataType.elementType.simpleString()
    out = StructType.fromDDL(f"item {item_kind}, id {id_kind}, score long")
    found = spark.createDataFrame([], out)
    if total["n_docs"]:
        asked = scratch.keep(asked, "asked")
        held = index.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).select("t.terms", "t.df")
        held = held.join(asked.select(F.col("term").alias("terms")).distinct(), "terms", "left_semi").groupBy("terms").agg(F.sum("df").alias("df"))
        weight = F.floor(1000 * F.ln((2 * F.lit(total["n_docs"]) + 2) / (2 * F.col("df") + 1)))
        weighted = scratch.keep(asked.join(held.select(F.col("terms").alias("term"), weight.alias("weight")).where("weight > 0"), "term"), "weighted")
        blocks = max(1, -(-weighted.count() // block_terms))
        types = to_arrow_schema(out).types
        for b in range(blocks):
            rows = weighted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).groupBy("item").agg(F.collect_list(F.struct("term", "weight")).alias("terms")).collect()  # about block_terms entries
            if not rows:
                continue
            number: dict[str, int] = {}
            of_item = [(np.array([number.setdefault(t["term"], len(number)) for t in r["terms"]]), np.array([t["weight"] for t in r["terms"]], dtype=np.int64)) for r in rows]
            shared = spark.sparkContext.broadcast(Asked([r["item"] for r in rows], list(number), of_item, total["n_docs"], total["n_terms"]))

            def searched(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                block = shared.value
                tops = [Top(k) for _ in block.items]
                for batch in batches:
                    for row in range(batch.num_rows):
                        whole = {name: batch.column(i)[row].values for i, name in enumerate(batch.schema.names)}
                        segment = {name: x.to_pylist() if name in ("ids", "terms") else x.to_numpy(zero_copy_only=False) for name, x in whole.items()}
                        block.search(segment, tops)
                best = [(item, id_[1], -score) for item, top in zip(block.items, tops) for score, id_ in top.rows]
                if best:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*best), types)], names=out.names)

            with _few_rows_at_once(spark):
                part = scratch.keep(index.select("ids", "sizes", "terms", "df", "places", "counts").mapInArrow(searched, out), f"block-{b}")
            shared.unpersist()
            found = part if b == 0 else found.unionByName(part)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_name), "score")


def rank_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = 10, **options) -> DataFrame:
    """``search`` of an index of ``docs`` made for it; ``options`` are those of build_index."""
    scratch = Scratch(docs.sparkSession, "ranked-search")
    return search(build_index(docs, scratch, id_col, text_col, **options), items, scratch, item_col, item_text, id_col, k)
