"""Best-fit packing of token sequences, planned on the histogram of lengths."""

from __future__ import annotations

import base64
import bisect
import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import Scratch


@functools.cache
def encoder(vocabulary: str) -> tiktoken.Encoding:
    """One a worker process. tiktoken reads the ranks of the vocabulary and gives the same ids as tokenizers
    does with its JSON file, in a third of the time; the added tokens of that file, as
    ``<|endoftext|>``, are tokens wherever their strings stand."""
    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    with open(public_tokenizers.path(f"{vocabulary}.json"), encoding="utf-8") as file:
        added = {x["content"]: x["id"] for x in json.load(file)["added_tokens"]}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks={k: v for k, v in table.items() if v not in added.values()}, special_tokens=added)


def tokenize_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end_id: int = 2, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """(id, piece, start, length, ids_crc32): a row for each piece of each row of ``docs``.

    A document is its ids and then ``end_id``. Longer ones than ``size`` are cut so that all pieces
    but the first have ``size`` ids. Null text: empty, one piece with the end id alone. Null and
    repeated ids are kept as they are. The vocabulary's files are found by name on the executors.
    """
    schema = "id " + docs.schema[id_col].dataType.simpleString() + ", piece int, start long, length long, ids_crc32 long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_to_numpy
        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(encode(text, allowed_special="all", disallowed_special=()), end_id).astype("<u4")
                n = len(ids)
                bounds = [0, *range(n % size or size, n + 1, size)] if n > size else [0, n]
                rows += [(i, k, a, b - a, zlib.crc32(ids[a:b])) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]
            row, *columns = np.array(rows, dtype=np.int64).reshape(-1, 5).T
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), *[pa.array(c, t) for c, t in zip(columns, types)]], ["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(cut, schema)


def plan_best_fit(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths: (length, first rank, number, first bin, items a bin, offset).

    Items of one length and bins of one free space are alike, so they are placed by the run: the
    work and the plan depend on the number of distinct lengths, not of documents.
    """
    plan, bins = [], 0
    free: dict[int, list[tuple[int, int]]] = {}  # free space: runs of (first bin, number of bins)
    spaces: list[int] = []

    def put(space: int, first: int, n: int) -> None:
        if space and n:
            if space not in free:
                bisect.insort(spaces, space)
                free[space] = []
            free[space].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, n = free[space].pop()
                if not free[space]:
                    del free[space]
                    spaces.pop(at)
            else:
                space, first = size, bins
                n = -(-left // (size // length))
                bins += n
            each = space // length
            used = min(n, left // each)
            if used:
                plan.append((length, rank, used * each, first, each, size - space))
                put(space - each * length, first, used)
                rank, left = rank + used * each, left - used * each
            if left and used < n:  # the last bin of the run takes what is left
                plan.append((length, rank, left, first + used, left, size - space))
                put(space - left * length, first + used, 1)
                left, used = 0, used + 1
            put(space, first + used, n - used)
    return plan


def pack(pieces: DataFrame, size: int = 1024, rows_a_cell: int = 100_000) -> DataFrame:
    """Adds sequence_id and offset to pieces, as few sequences of at most ``size`` ids as best fit gives.

    The driver sees the histogram (at most ``size`` rows) and broadcasts the plan, whose length is
    bounded by ``size`` too. Pieces take slots by rank within their length. Ranks are counted in
    hash cells for each length and shifted by the cells' running totals, so a length that many pieces
    share is no single task: it has as many cells as its count asks for, about ``rows_a_cell`` rows
    each, 64 at least where it is the commonest. Equal rows are interchangeable. No pieces: no rows.
    """
    spark = pieces.sparkSession
    kept = Scratch(spark, "packing").keep(pieces, "pieces")
    counts = {r["length"]: r["count"] for r in kept.groupBy("length").count().collect()}
    cells = max(64, -(-max(counts.values(), default=0) // rows_a_cell))
    kept = kept.withColumn("cell", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(cells)))
    plan = spark.createDataFrame(plan_best_fit(counts, size), "length long, first long, number long, first_bin long, each long, base long")
    totals = kept.groupBy("length", "cell").count()
    before = F.expr("coalesce(sum(`count`) over (partition by length order by cell rows between unbounded preceding and 1 preceding), 0)")
    shifts = totals.select("length", "cell", before.alias("before"))  # a row for each length and cell
    ranked = kept.withColumn("in_cell", F.expr("row_number() over (partition by length, cell order by id, piece, ids_crc32)"))
    if size * cells <= 1_000_000:  # beyond, Spark chooses by the size it meets
        shifts = F.broadcast(shifts)
    ranked = ranked.join(shifts, ["length", "cell"]).withColumn("rank", F.col("before") + F.col("in_cell") - 1)
    rank = F.col("rank") - F.col("first")
    return (
        ranked.join(F.broadcast(plan), "length")
        .where((rank >= 0) & (rank < F.col("number")))
        .select(*pieces.columns, (F.col("first_bin") + F.floor(rank / F.col("each"))).alias("sequence_id"), (F.col("base") + (rank % F.col("each")) * F.col("length")).alias("offset"))
    )
