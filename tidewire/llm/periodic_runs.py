"""Periodic runs: stretches of words that repeat with one period, found by a sparse diagonal pass over lags."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tidewire.llm.common import bounded_batches

#: What separates words.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RUNS = ArrayType(StructType([StructField(c, LongType()) for c in ("start", "length", "period")]))


def _earlier(names: np.ndarray) -> np.ndarray:
    """For each entry, the place of the latest earlier entry of the same name, or -1."""
    order = np.argsort(names, kind="stable")
    same = np.flatnonzero(names[order[1:]] == names[order[:-1]]) + 1
    out = np.full(len(names), -1, dtype=np.int64)
    out[order[same]] = order[same - 1]
    return out


def _renamed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of the pairs (a, b): equal for equal pairs."""
    return pd.factorize(a * (int(b.max(initial=0)) + 1) + b)[0].astype(np.int64)


def periodic_stretches(names: np.ndarray, times: int = 4, least: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs in a sequence of word numbers, in order of start and period.

    A lag is a diagonal of the table of word pairs; word i adds one to the match length of lag d where
    it equals word i-d. A run of period d is a diagonal with a match of ``(times - 1) * d`` words or
    more. Lags are followed by octaves, [B/2, B): there, a word's earlier occurrence is that of the
    phrase of B words that begins with it, and the latest one names the only lag that can matter. Two
    phrases of B > d words in a run of primitive period d are equal only at multiples of d, so within
    a run the latest earlier occurrence is d back, and a lag that is a multiple of a smaller period is
    never the latest. So each word extends one active diagonal an octave, and a diagonal that ends
    emits its run at once: the words before and behind it differ. Only phrases that repeat are kept
    for the next octave (their halves repeat), so the work is O(n log n), and little more than O(n)
    in text that seldom repeats. ``times`` of 4 or more keeps two phrases within each run.
    """
    n = len(names)
    none = np.zeros(0, dtype=np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    own = pd.factorize(names)[0].astype(np.int64)
    at = np.flatnonzero(np.bincount(own)[own] > 1) if n else none  # phrases of one word
    own, size = own[at], 1
    while len(at) and 2 * size * (times // 2) <= n:
        # a phrase of twice the size is one here and one right behind it
        behind = np.searchsorted(at, at + size)
        here = np.flatnonzero(behind < len(at))
        here = here[at[behind[here]] == at[here] + size]
        at, own = at[here], _renamed(own[here], own[behind[here]])
        size *= 2
        before = _earlier(own)
        lag = np.where(before >= 0, at - at[before], 0)
        active = (lag >= size // 2) & (lag < size)
        # a diagonal goes on while the next word keeps the lag
        on = active[1:] & active[:-1] & (lag[1:] == lag[:-1]) & (at[1:] == at[:-1] + 1)
        begins = np.flatnonzero(active & ~np.r_[False, on]) if len(at) else none
        ends = np.flatnonzero(active & ~np.r_[on, False]) if len(at) else none
        d = lag[begins]
        length = d + (ends - begins) + size
        enough = length >= np.maximum(least, times * d)
        found.append((at[begins][enough] - d[enough], length[enough], d[enough]))
        # phrases that stand alone have no repeat at any larger size
        repeats = np.bincount(own, minlength=1)[own] > 1 if len(own) else np.zeros(0, dtype=bool)
        at, own = at[repeats], own[repeats]
    start, length, period = (np.concatenate([x[k] for x in found]) if found else none for k in range(3))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _parts(texts: list[str | None], size: int) -> Iterator[list[str]]:
    """The texts in parts of about ``size`` characters; a longer text is a part of its own."""
    part, held = [], 0
    for text in texts:
        if part and held + len(text or "") > size:
            yield part
            part, held = [], 0
        part.append(text or "")
        held += len(text or "")
    if part:
        yield part


def _runs_of(texts: list[str], times: int, least: int) -> Iterator[tuple[list[dict], int, str]]:
    """(runs, number of words, words that stay) of each text; one pass over the words of all."""
    words = [WORD.findall(x) for x in texts]
    sizes = np.array([len(x) for x in words], dtype=np.int64)
    firsts = np.r_[0, np.cumsum(sizes)]
    flat = [w for own in words for w in own]
    codes = pd.factorize(np.array(flat, dtype=object))[0].astype(np.int64) if flat else np.zeros(0, dtype=np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    start, length, period = periodic_stretches(codes * len(texts) + doc, times, least)  # a word of another text is another word
    stays = np.ones(len(flat) + 1, dtype=np.int64)
    marks = np.zeros(len(flat) + 1, dtype=np.int64)
    np.add.at(marks, start + period, 1)
    np.add.at(marks, start + length, -1)
    stays = np.cumsum(marks) == 0
    of = doc[start] if len(start) else start
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    for k, own in enumerate(words):
        a, b = bounds[k], bounds[k + 1]
        first = firsts[k]
        runs = [{"start": int(s - first), "length": int(m), "period": int(q)} for s, m, q in zip(start[a:b], length[a:b], period[a:b], strict=True)]
        yield runs, len(own), " ".join(w for w, stay in zip(own, stays[first : first + len(own)]) if stay) if runs else " ".join(own)


def strongest(runs: Column) -> Column:
    """The run with the greatest length/period, compared as fractions; of equals the first. Null without runs."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    more = lambda best, x: best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    return F.aggregate(runs, none, lambda best, x: F.when(more(best, x), x).otherwise(best))


def find_runs(docs: DataFrame, text_col: str = "text", times: int = 4, least: int = 6, part: int = 2_000_000) -> DataFrame:
    """The columns of ``docs`` with runs, n_words, collapsed; columns of these names are replaced.

    ``runs`` holds (start, length, period) by start and period: every stretch of words with smallest
    period ``period`` that is at least ``times`` periods and ``least`` words long and that no
    neighbouring word extends. ``collapsed`` is the words, joined by one space, without those behind
    the first period of a run. Null and empty texts have no words and no runs. Texts are worked on
    whole, about ``part`` characters of a batch at a time. Every row is worked on by itself, so
    null, repeated and tied ids change nothing, and no rows give none.
    """
    if times < 4:
        raise ValueError("runs of fewer than four periods are not found")
    bounded_batches(docs.sparkSession)
    added = ("runs", "n_words", "collapsed")
    # the text goes first, under whatever name: another column may be one that is replaced
    own = docs.select(F.col(text_col), *[F.col(f"`{c}`") for c in docs.columns if c not in added])
    kinds = StructType([StructField("runs", RUNS), StructField("n_words", LongType()), StructField("collapsed", StringType())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x for own in _parts(batch.column(0).to_pylist(), part) for x in _runs_of(own, times, least)]
            made = [pa.array(x, kind) for x, kind in zip(zip(*rows) if rows else ((), (), ()), to_arrow_schema(kinds).types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], names=[*batch.schema.names[1:], *kinds.names])

    return own.mapInArrow(of, StructType([*own.schema.fields[1:], *kinds.fields]))
