"""Suffix-array dedup: a logarithmic family of sparse suffix arrays finds byte strings that start more than once."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import Scratch

#: Multiplier of the polynomial hashes, and its inverse modulo 2**64.
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)
#: A hash for each byte, so that strings of two symbols do not cancel.
BYTES = np.random.default_rng(11).integers(1, 1 << 63, size=256, dtype=np.uint64) | np.uint64(1)
SPAN = 1 << 20
LOW = np.uint64(SPAN - 1)
#: Sets the keys of strings of words apart from those of bytes.
WORDS = np.uint64(0x5851F42D4C957F2D)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


UP, DOWN = _powers(BASE, SPAN + 1), _powers(INVERSE, SPAN + 1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(29))


def _sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash of symbols; up to SPAN of them."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * UP[: len(values)], out=out[1:])
    return out


def _hashes(sums: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    return _mixed((sums[starts + width] - sums[starts]) * DOWN[starts])


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each word; ASCII white space parts words."""
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate(([1], blank.view(np.int8), [1])))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_values(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each word, of its bytes alone."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    if len(raw) <= SPAN:
        sums = _sums(BYTES[raw])
        return _mixed((sums[ends] - sums[starts]) * DOWN[starts]) | np.uint64(1)
    sizes = ends - starts
    at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    inside = np.arange(sizes.sum()) - np.repeat(at, sizes)
    return _mixed(np.add.reduceat(BYTES[raw[np.repeat(starts, sizes) + inside]] * UP[inside % SPAN], at)) | np.uint64(1)


def sampled_suffixes(values: np.ndarray, match: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, key, first, last) of the suffixes that the sparse array keeps of one text's symbols.

    Every string of ``match`` symbols keeps the suffix in it whose first ``prefix`` symbols have the
    smallest hash, leftmost on ties: a choice that its symbols alone make, so equal strings keep
    equal suffixes. ``first`` and ``last`` bound the starts of the strings that chose the suffix.
    """
    n, w = len(values), match - prefix + 1
    parts, step = [], SPAN - match
    for at in range(0, max(0, n - match + 1), step):
        piece = values[at : at + step + match - 1]
        h = _hashes(_sums(piece), np.arange(len(piece) - prefix + 1), prefix)
        # high bits of the hash, then the place: the minimum of a window tells where it is, leftmost on ties
        packed = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)
        m = len(h) - w + 1
        blocks = np.concatenate([packed, np.full(-len(h) % w, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, w)
        forward = np.minimum.accumulate(blocks, axis=1).ravel()
        backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        chosen = (np.minimum(backward[:m], forward[w - 1 : w - 1 + m]) & LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
        last = np.concatenate((first[1:], [m])) - 1
        parts.append((chosen[first] + at, h[chosen[first]], first + at, last + at))
    if not parts:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return tuple(np.concatenate(x) for x in zip(*parts))  # type: ignore[return-value]


def local_repeats(values: np.ndarray, suffixes: tuple[np.ndarray, ...], match: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(which suffixes to keep, repeated ranges) of one text's own repeats.

    A string of ``match`` symbols that starts twice in a text is repeated whatever other texts say, and
    one of its starts is enough for them. So suffixes whose strings all start earlier too are
    left out: a text that says one word again and again keeps a few suffixes, not one a word.
    Strings of a text that look alike by hash are compared symbol by symbol.
    """
    place, key, first, last = suffixes
    in_order = np.sort(key)
    if not (in_order[1:] == in_order[:-1]).any():
        return np.ones(len(key), dtype=bool), []
    _, back, n = np.unique(key, return_inverse=True, return_counts=True)
    keep, ranges = np.ones(len(key), dtype=bool), []
    own = np.flatnonzero(n[back] > 1)
    size = (last - first + 1)[own]
    who = np.repeat(own, size)
    start = np.repeat(first[own] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
    hashes = np.empty(len(start), dtype=np.uint64)
    for a in range(0, len(values), SPAN - match):  # starts of this stretch
        b = min(len(values), a + SPAN - match)
        part = (start >= a) & (start < b)
        if part.any():
            hashes[part] = _hashes(_sums(values[a : b + match]), start[part] - a, match)
    order = np.lexsort((start, hashes))
    h, at = hashes[order], start[order]
    new = np.concatenate(([True], h[1:] != h[:-1]))
    head = at[np.flatnonzero(new)][np.cumsum(new) - 1]
    # runs of starts that meet runs of first starts: each run is one comparison
    later = np.flatnonzero(~new)
    later = later[np.argsort(at[later], kind="stable")]
    equal = np.zeros(len(at), dtype=bool)
    if len(later):
        cut = np.flatnonzero(np.concatenate(([True], (np.diff(at[later]) != 1) | (np.diff(head[later]) != 1), [True])))
        for a, b in zip(cut[:-1], cut[1:]):
            x, y, long = at[later[a]], head[later[a]], b - a - 1 + match
            equal[later[a:b]] = np.array_equal(values[x : x + long], values[y : y + long])
    twice = equal.copy()
    firsts = np.flatnonzero(new)[(np.cumsum(new) - 1)[equal]]
    twice[firsts] = True
    keep[own] = False
    keep[who[order[~equal]]] = True
    starts = np.sort(at[twice])
    if len(starts):
        cut = np.flatnonzero(np.concatenate(([True], np.diff(starts) > match)))
        ranges = list(zip(starts[cut].tolist(), (starts[np.concatenate((cut[1:] - 1, [len(starts) - 1]))] + match).tolist()))
    return keep, ranges


def _symbols(said: bytes, worded: bool) -> tuple[bytes | list[bytes], np.ndarray]:
    """(symbols, their values) of a text: its bytes, or its words."""
    raw = np.frombuffer(said, dtype=np.uint8)
    if not worded:
        return said, BYTES[raw]
    return said.split(), word_values(raw, *word_bounds(raw))


def window_hashes(values: list[np.ndarray], match: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset, hash) of every string of ``match`` symbols of each row, in order."""
    out = [_hashes(_sums(v), np.arange(len(v) - match + 1), match) for v in values]
    n = np.array([len(h) for h in out])
    row = np.repeat(np.arange(len(out)), n)
    return row, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), np.concatenate(out) >> np.uint64(64 - bits)


def repeated_windows(said: list[bytes], doc: np.ndarray, match: int, worded: bool, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last): starts of strings of ``match`` symbols that several rows, or one row twice, hold.

    Strings of words count if rows of two docs hold them. Strings meet by hash (of ``bits`` bits)
    and are compared symbol by symbol: a stretch of them that meets a stretch is one comparison.
    Where hashes of different strings are equal, all strings of that hash are grouped by what they say.
    """
    symbols, values = zip(*[_symbols(x, worded) for x in said])
    row, offset, h = window_hashes(list(values), match, bits)
    order = np.argsort(h, kind="stable")
    new = np.concatenate(([True], h[order][1:] != h[order][:-1]))
    group = np.cumsum(new) - 1
    head = order[new][group]
    several = np.bincount(group) > 1
    if worded:
        several &= np.bincount(group, weights=doc[row[order]] != doc[row[head]]) > 0
    rep = np.full(len(h), -1, dtype=np.int64)
    rep[order[several[group]]] = head[several[group]]
    later = np.flatnonzero((rep >= 0) & (rep != np.arange(len(h))))
    hit = np.zeros(len(h), dtype=bool)
    doubt = []
    if len(later):
        to = rep[later]
        same = (np.diff(later) == 1) & (np.diff(to) == 1) & (np.diff(row[later]) == 0) & (np.diff(row[to]) == 0)
        cut = np.flatnonzero(np.concatenate(([True], ~same, [True]))).tolist()
        x, y = later[cut[:-1]], to[cut[:-1]]
        for a, b, i, j, rx, ox, ry, oy in zip(cut[:-1], cut[1:], x.tolist(), y.tolist(), row[x].tolist(), offset[x].tolist(), row[y].tolist(), offset[y].tolist()):
            long = b - a - 1 + match
            if symbols[rx][ox : ox + long] == symbols[ry][oy : oy + long]:
                hit[i : i + b - a] = hit[j : j + b - a] = True
            else:
                doubt.append(h[later[a:b]])
    if doubt:
        for value in np.unique(np.concatenate(doubt)):
            members = np.flatnonzero(h == value)
            hit[members] = False
            held: dict[object, list[int]] = {}
            for m in members.tolist():
                part = symbols[row[m]][offset[m] : offset[m] + match]
                held.setdefault(tuple(part) if worded else part, []).append(m)
            for own in held.values():
                hit[own] |= len(own) > 1 and (not worded or len(set(doc[row[own]].tolist())) > 1)
    who = np.flatnonzero(hit)
    at = np.flatnonzero(np.concatenate(([True], row[who][1:] != row[who][:-1]))) if len(who) else np.zeros(0, np.int64)
    if not len(at):
        return at, at, at
    return row[who[at]], np.minimum.reduceat(offset[who], at), np.maximum.reduceat(offset[who], at)


class SuffixFamily:
    """Sorted arrays of sampled suffixes in one folder, of sizes 1, 2, 4, ... batches: a logarithmic index.

    ``add`` indexes a batch: its array is sorted, merge-scanned against the arrays of all levels for
    keys that both have, and put in level 0; while a level has two arrays, they merge into one of
    the next, run by run. An array is a set of runs, dealt by text, each in order of the first eight
    bytes of its suffixes, then of the key, a hash of the whole prefix; suffixes that agree on it,
    the only ones that can be part of a long match, are neighbours. The folder keeps the levels, so a family on the same folder goes on
    with what is there.
    """

    ORDER = ("head", "key", "doc", "place")
    SCHEMA = "head long, key long, worded boolean, doc binary, place long, back int, least int, local boolean"

    def __init__(self, spark: SparkSession, folder: str, match: int = 400, prefix: int = 128, words: int = 51, words_prefix: int = 12):
        self.scratch = Scratch(spark, "suffix-family", folder)
        self.match, self.prefix, self.words, self.words_prefix = match, prefix, words, words_prefix
        self.levels: dict[int, tuple[str, DataFrame]] = {}
        self.added = 0
        for name in self.scratch.names():
            if found := re.fullmatch(r"array-(\d+)-(\d+)", name):
                self.added = max(self.added, int(found[1]))
                self.levels[int(found[2])] = (name, self.scratch.read(name, self.SCHEMA))

    def entries(self) -> DataFrame | None:
        """All suffixes of all levels."""
        out = None
        for _, level in self.levels.values():
            out = level if out is None else out.union(level)
        return out

    def _array(self, texts: DataFrame) -> DataFrame:
        match, prefix, n_words, words_prefix = self.match, self.prefix, self.words, self.words_prefix

        def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = set()
            for batch in batches:
                docs, out = batch.column(0), []

                def rows(i: int, found: tuple[np.ndarray, ...], keep: np.ndarray, heads: np.ndarray, worded: bool) -> None:
                    p, key, first, last = (x[keep] for x in found)
                    n = len(p)
                    out.append((np.full(n, i), heads[keep], key.view(np.int64), np.full(n, worded), p, (p - first).astype(np.int32), (p - last).astype(np.int32), np.zeros(n, dtype=bool)))

                for i, text in enumerate(batch.column(1)):
                    if (name := docs[i].as_py()) in seen:  # a copy has the same suffixes
                        continue
                    seen.add(name)
                    raw = np.frombuffer(text.as_buffer(), dtype=np.uint8)
                    padded = np.concatenate((raw, np.zeros(8, np.uint8)))

                    def heads(at: np.ndarray) -> np.ndarray:
                        first = np.zeros(len(at), dtype=np.uint64)
                        for k in range(8):
                            first = (first << np.uint64(8)) | padded[at + k].astype(np.uint64)
                        return (first ^ np.uint64(1 << 63)).view(np.int64)  # signed order is the order of the bytes

                    if len(raw) >= match:
                        values = BYTES[raw]
                        found = sampled_suffixes(values, match, prefix)
                        keep, ranges = local_repeats(values, found, match)
                        rows(i, found, keep, heads(found[0]), False)
                        if ranges:  # a range of its own: place is its start, back its length; the key spreads such rows
                            a, b = np.array(ranges).T
                            spread = _mixed(a.astype(np.uint64) + found[1][0]).view(np.int64)
                            out.append((np.full(len(a), i), spread, spread, np.zeros(len(a), dtype=bool), a, (b - a).astype(np.int32), np.zeros(len(a), np.int32), np.ones(len(a), dtype=bool)))
                    starts, ends = word_bounds(raw)
                    if len(starts) >= n_words:
                        values = word_values(raw, starts, ends)
                        p, key, first, last = sampled_suffixes(values, n_words, words_prefix)
                        found = (p, key ^ WORDS, first, last)
                        rows(i, found, local_repeats(values, found, n_words)[0], heads(starts[p]), True)
                if out:
                    i, *columns = (np.concatenate(x) for x in zip(*out))
                    head, key, worded, *others = map(pa.array, columns)
                    yield pa.RecordBatch.from_arrays([head, key, worded, docs.take(pa.array(i)), *others], ["head", "key", "worded", "doc", "place", "back", "least", "local"])

        # by doc: no passage that many texts share is one task's; copies of a text meet and one is left
        return texts.select("doc", "text").mapInArrow(suffixes, self.SCHEMA).repartition("doc").dropDuplicates().sortWithinPartitions(*self.ORDER)

    def _merged(self, arrays: list[DataFrame]) -> DataFrame:
        """One array of several: runs that lie side by side become one, without a shuffle."""
        out = arrays[0]
        for other in arrays[1:]:
            out = out.union(other)
        return out.coalesce(max(a.rdd.getNumPartitions() for a in arrays)).sortWithinPartitions(*self.ORDER)

    def add(self, texts: DataFrame) -> DataFrame:
        """Indexes a batch (doc, text); returns the keys that it has twice or shares with an earlier batch."""
        self.added += 1
        name, level = f"array-{self.added}-0", 0
        merges = level in self.levels
        array = self.scratch.keep(self._array(texts), f"new-{self.added}" if merges else name)
        new, old = array.where("not local"), self.entries()
        hits = new.groupBy("key").agg(F.count("*").alias("n"))
        if old is not None:  # both sides in order of the key: a merge scan
            hits = hits.hint("merge").join(old.where("not local").select("key").distinct().withColumn("old", F.lit(True)), "key", "left").where("n > 1 or old")
        else:
            hits = hits.where("n > 1")
        hits = self.scratch.keep(hits.select("key"), f"hits-{self.added}")
        taken, arrays = [f"new-{self.added}"], [array]
        while level in self.levels:  # two arrays of one size make one of the next level
            other, table = self.levels.pop(level)
            arrays, level = [*arrays, table], level + 1
            taken.append(other)
        if merges:
            name = f"array-{self.added}-{level}"
            array = self.scratch.keep(self._merged(arrays), name)
            self.scratch.drop(*taken)
        self.levels[level] = (name, array)
        return hits

    def drop(self) -> None:
        """Deletes the levels."""
        self.scratch.drop(*[name for name, _ in self.levels.values()])
        self.levels = {}


def _bytes_of(rows: DataFrame, own: DataFrame) -> DataFrame:
    """Adds ``said``, the symbols from place - back to the end of the last string that chose the suffix, to rows of suffixes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts, lists = batch.column("doc"), batch.column("text"), batch.column("at")
            for i in range(len(batch)):
                at, text = lists[i].values, texts[i].as_buffer().to_pybytes()
                key, worded, start, end, hot = (at.field(n).to_numpy(zero_copy_only=False) for n in ("key", "worded", "start", "end", "hot"))
                words = text.split() if worded.any() else []
                said = [b" ".join(words[a:b]) if w else text[a:b] for a, b, w in zip(start.tolist(), end.tolist(), worded.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(worded.astype(bool)), docs.take(pa.array(np.full(len(key), i))), pa.array(start), pa.array(said, pa.binary()), pa.array(hot.astype(bool))],
                    ["key", "worded", "doc", "start", "said", "hot"],
                )

    lists = rows.groupBy("doc").agg(F.collect_list(F.struct("key", "worded", "start", "end", "hot")).alias("at"))
    return own.join(lists, "doc").select("doc", "text", "at").mapInArrow(cut, "key long, worded boolean, doc binary, start long, said binary, hot boolean")


def _compared(around: DataFrame, match: int, words: int, bits: int) -> DataFrame:
    """(doc, worded, start, end) of what repeats among rows of equal keys, a stretch of whole keys at a time."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            of = rows.column("worded").to_numpy()
            for worded, size in ((False, match), (True, words)):
                own = rows.filter(pa.array(of == worded))
                if not len(own):
                    continue
                doc = own.column("doc").combine_chunks()
                code = doc.dictionary_encode().indices.to_numpy()
                row, low, high = repeated_windows(own.column("said").to_pylist(), code, size, worded, bits)
                start = own.column("start").to_numpy()[row]
                yield pa.RecordBatch.from_arrays([doc.take(pa.array(row)), pa.array(np.full(len(row), worded)), pa.array(start + low), pa.array(start + high + size)], ["doc", "worded", "start", "end"])

        waiting: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            waiting.append(batch)
            size += len(batch)
            if size < 8192:
                continue
            rows = pa.Table.from_batches(waiting)
            key = rows.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1], "left"))  # the last key may go on
            if cut:
                yield from out(rows.slice(0, cut))
                waiting = rows.slice(cut).to_batches()
                size = len(rows) - cut
        if waiting and size:
            yield from out(pa.Table.from_batches(waiting))

    return around.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "doc binary, worded boolean, start long, end long")


def _spread(around: DataFrame, scratch: Scratch, match: int, words: int, bits: int) -> DataFrame:
    """As _compared, for keys of very many rows: strings meet in a shuffle with partial sums, and no key is one task."""

    def windows(with_bytes: bool):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, len(batch), 256):
                    part = batch.slice(a, 256)
                    of = part.column("worded").to_numpy(zero_copy_only=False).astype(bool)
                    for worded, size in ((False, match), (True, words)):
                        rows = part.filter(pa.array(of == worded))
                        if not len(rows):
                            continue
                        said = rows.column("said").to_pylist()
                        row, offset, h = window_hashes([_symbols(x, worded)[1] for x in said], size, bits)
                        low, high = [], []
                        for k, x in enumerate(said):
                            own = offset[row == k]
                            starts, ends = word_bounds(np.frombuffer(x, dtype=np.uint8)) if worded else (np.arange(len(x)), np.arange(len(x)) + 1)
                            low.append(starts[own])
                            high.append(ends[own + size - 1])
                        low, high, start = np.concatenate(low), np.concatenate(high), rows.column("start").to_numpy()
                        columns = [rows.column("key").take(pa.array(row)), pa.array(np.full(len(row), worded)), rows.column("doc").take(pa.array(row)), pa.array(start[row]), pa.array(offset), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))]
                        last = pa.array([said[r][x:y] for r, x, y in zip(row.tolist(), low.tolist(), high.tolist())], pa.binary()) if with_bytes else pa.array(h.view(np.int64))
                        yield pa.RecordBatch.from_arrays([*columns, last], ["key", "worded", "doc", "start", "offset", "low", "high", "what"])

        return each

    schema = "key long, worded boolean, doc binary, start long, offset long, low int, high int, what "
    size = F.when(F.col("worded"), words).otherwise(match)
    many = (F.count("*") > 1) & (~F.col("worded") | (F.min("doc") != F.max("doc")))
    each = around.mapInArrow(windows(False), schema + "long")
    heads = each.groupBy("key", "worded", "what").agg(F.min(F.struct("doc", "start", "low", "high")).alias("head"), many.alias("many")).where("many")
    met = each.join(heads, ["key", "worded", "what"])
    # a row's strings that meet one other row's are one stretch, as a row's strings all overlap
    stretches = met.groupBy("key", "worded", "doc", "start", F.col("head.doc").alias("doc_b"), F.col("head.start").alias("start_b"), (F.col("low") - F.col("head.low")).alias("shift")).agg(
        F.min("offset").alias("first"), F.max("offset").alias("last"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("head.low").alias("low_b"), F.max("head.high").alias("high_b")
    )
    stretches = scratch.keep(stretches, "stretches")
    side_b = around.select("key", "worded", F.col("doc").alias("doc_b"), F.col("start").alias("start_b"), F.col("said").alias("said_b"))
    held = stretches.join(around.select("key", "worded", "doc", "start", "said"), ["key", "worded", "doc", "start"]).join(side_b, ["key", "worded", "doc_b", "start_b"])
    said, said_b = F.substring("said", F.col("low") + 1, F.col("high") - F.col("low")), F.substring("said_b", F.col("low_b") + 1, F.col("high_b") - F.col("low_b"))
    judged = scratch.keep(held.select("key", "worded", "doc", "start", "first", "last", (said == said_b).alias("same")), "judged")
    wrong = scratch.keep(judged.where("not same").select("key", "worded").distinct(), "wrong")
    right = judged.join(wrong, ["key", "worded"], "left_anti").select("doc", "worded", (F.col("start") + F.col("first")).alias("start"), (F.col("start") + F.col("last") + size).alias("end"))
    # keys where strings of one hash differ: by their bytes
    exact = around.join(wrong, ["key", "worded"], "left_semi").mapInArrow(windows(True), schema + "binary")
    twice = exact.groupBy("key", "worded", "what").agg(many.alias("many")).where("many")
    slow = exact.join(twice, ["key", "worded", "what"], "left_semi").select("doc", "worded", (F.col("start") + F.col("offset")).alias("start"), (F.col("start") + F.col("offset") + size).alias("end"))
    return right.union(slow)


def repeated_spans(texts: DataFrame, copied: DataFrame, match: int = 400, prefix: int = 128, batches: int = 4, hot: int = 3000, words: int = 51, words_prefix: int = 12, hash_bits: int = 64) -> DataFrame:
    """(doc, worded, start, end): ranges covered by strings of ``match`` bytes that start more than once, and, where
    ``worded``, ranges of words covered by strings of ``words`` words that other texts have too.

    ``texts`` has id, doc (binary, equal for equal texts) and text (not null); ``copied`` has the docs
    of several rows, with the least id of each. Suffixes are sampled by what each string says (see
    sampled_suffixes), so two equal strings meet at one suffix prefix. The texts come in ``batches``
    to a family of sorted arrays (see SuffixFamily), each merge-scanned against the existing levels for
    prefixes that repeat. Only those suffixes then fetch the symbols around them, and the strings that
    chose them meet by hash and are compared whole. Prefixes of more than ``hot`` suffixes are compared
    string by string in a shuffle with partial sums instead of in one task; both ways find the same
    strings. ``hash_bits`` is for tests of equal hashes.
    """
    spark = texts.sparkSession
    scratch = Scratch(spark, "suffix-dedup")
    family = SuffixFamily(spark, scratch.path("family"), match, prefix, words, words_prefix)
    own = texts.where(F.octet_length("text") >= min(match, 2 * words - 1))
    repeated: DataFrame | None = None
    for k in range(batches):
        hits = family.add(own.where(F.pmod(F.xxhash64("doc"), F.lit(batches)) == k))
        repeated = hits if repeated is None else repeated.union(hits)
    entries = family.entries().where("not local")
    counts = entries.join(repeated.distinct(), "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"))
    start, size = F.col("place") - F.col("back"), F.when(F.col("worded"), words).otherwise(match)
    chosen = entries.join(counts, "key").select("doc", "key", "worded", start.alias("start"), (F.col("place") - F.col("least") + size).alias("end"), (F.col("n") > hot).alias("hot"))
    named = own.join(copied.select("doc", "least", F.lit(True).alias("several")), "doc", "left").where(F.col("several").isNull() | F.col("id").eqNullSafe(F.col("least")))
    around = scratch.keep(_bytes_of(chosen, named.select("doc", "text")), "around")
    alone = scratch.keep(family.entries().where("local").select("doc", "worded", F.col("place").alias("start"), (F.col("place") + F.col("back")).alias("end")), "local")
    family.drop()
    found = scratch.keep(_compared(around.where("not hot"), match, words, hash_bits), "found")
    return found.union(_spread(around.where("hot"), scratch, match, words, hash_bits)).union(alone)


def _merged(spans: list[tuple[int, int]], touching: bool) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and (a < out[-1][1] or touching and a == out[-1][1]):
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def remove_spans(text: Column, spans: Column, several: Column, words: int) -> Column:
    """Struct (kept binary, n_removed, n_spans, passages) of a text without the union of its spans of bytes; passages is
    the union of its spans of words, or all words of a text of ``words`` words or more that ``several`` rows have."""

    @F.pandas_udf("struct<kept:binary,n_removed:long,n_spans:long,passages:array<struct<first:long,end:long>>>")
    def cut(texts: pd.Series, all_spans: pd.Series, copies: pd.Series) -> pd.DataFrame:
        rows = []
        for value, own, copied in zip(texts.tolist(), all_spans.tolist(), copies.tolist(), strict=True):
            raw = value.encode("utf-8", "surrogatepass")
            spans_ = [(s["start"], s["end"], s["worded"]) for s in own] if own is not None else []
            merged = _merged([(a, b) for a, b, worded in spans_ if not worded], True)
            passages = _merged([(a, b) for a, b, worded in spans_ if worded], False)
            if copied:
                passages = [(0, n)] if (n := len(raw.split())) >= words else []
            kept, at = [], 0
            for a, b in merged:
                kept.append(raw[at:a])
                at = b
            kept.append(raw[at:])
            rows.append((b"".join(kept), sum(b - a for a, b in merged), len(merged), [{"first": a, "end": b} for a, b in passages]))
        return pd.DataFrame(rows, columns=["kept", "n_removed", "n_spans", "passages"])

    return cut(text, spans, several)


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", match: int = 400, prefix: int = 128, words: int = 51, **options) -> DataFrame:
    """(id, n_bytes, kept, n_removed, n_spans, passages): one row a row of ``docs``.

    Each byte goes that is covered by a string of ``match`` bytes which also starts anywhere else,
    in the same text too; strings never cross texts and are judged on the input. ``passages`` are
    the (first, end) words, parted by ASCII white space, of maximal runs covered by strings of
    ``words`` words that another row has too; they are told, not removed, as a passage of over 50
    words can be shorter than ``match`` bytes. A passage that stands twice in one text is told at
    its first place. A text of ``match`` bytes, or ``words`` words, or more that several rows have goes, or is
    told, whole; the others, and one of each such text, are indexed (see repeated_spans). Null text:
    empty. Shorter texts stay. Equal rows get equal results; other columns are not read. No rows
    give no rows.
    """
    scratch = Scratch(docs.sparkSession, "byte-dedup")
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("doc", F.unhex(F.md5("text")))
    size = F.octet_length("text").cast("long")
    # ids and hashes, no texts: one row of each text of several rows is indexed for the others
    copied = own.where(size >= min(match, 2 * words - 1)).groupBy("doc").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.max(size).alias("size")).where("n > 1")
    copied = scratch.keep(copied, "copied")
    spans = repeated_spans(own, copied, match, prefix, words=words, **options)
    spans = spans.union(copied.where(F.col("size") >= match).select("doc", F.lit(False), F.lit(0).cast("long"), "size"))
    merged = scratch.keep(spans.groupBy("doc").agg(F.collect_list(F.struct("worded", "start", "end")).alias("spans")), "spans")
    done = own.join(merged, "doc", "left").join(copied.select("doc", F.lit(True).alias("several")), "doc", "left")
    done = done.withColumn("cut", remove_spans(F.col("text"), F.col("spans"), F.coalesce("several", F.lit(False)), words))
    return done.select(F.col("id").alias(id_col), size.alias("n_bytes"), "cut.kept", "cut.n_removed", "cut.n_spans", "cut.passages")
