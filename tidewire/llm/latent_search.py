"""Benchmark decontamination by latent semantic retrieval: TF-IDF, randomised SVD, cosine candidates, then word checks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import Scratch

UNIT = 4
#: Window sizes in words; a passage is sought in windows of the next size.
SIZES = (16, 32, 64, 128)
LONGEST = 96
SPACES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased words; ASCII marks and white space part them."""
    return text.lower().encode("utf-8", "surrogatepass").translate(SPACES).split()


def answer_of(text: str) -> list[bytes]:
    """The words of an item's answer: what follows its last question mark, else its last sentence."""
    tail = text.rsplit("?", 1)[1] if "?" in text else re.split(r"(?<=[.!])\s+", text.strip())[-1]
    return words_of(tail)


def passages_of(words: list[bytes]) -> list[list[bytes]]:
    """Nearly equal passages of at most LONGEST words."""
    n = -(-len(words) // LONGEST)
    return [words[len(words) * i // n : len(words) * (i + 1) // n] for i in range(n)]


def common_subsequence(masks: dict[bytes, int], n: int, words: list[bytes]) -> int:
    """Length of the longest common subsequence with the n words of the masks, bit-parallel."""
    full = (1 << n) - 1
    v = full
    for m in filter(None, map(masks.get, words)):
        u = v & m
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def document_frequencies(texts: DataFrame, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """(how many of the texts have each word, number of texts), counted over all rows of column ``text``."""
    size, known = len(vocabulary), frozenset(vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            for text in batch["text"].tolist():
                seen[[vocabulary[w] for w in known.intersection(words_of(text or ""))]] += 1
                seen[size] += 1
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"f": at, "n": seen[at]})

    summed = texts.select("text").mapInPandas(count, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toPandas()  # a row for each word of the block
    out = np.zeros(size + 1, dtype=np.int64)
    out[summed["f"].to_numpy(dtype=np.int64)] = summed["n"].to_numpy(dtype=np.int64)
    return out[:size], int(out[size])


def _rows(texts: list[str], vocabulary: dict[bytes, int], idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, unit TF-IDF weights) of every passage of every text."""
    for text in texts:
        words = words_of(text or "")
        for passage in passages_of(words) if words else []:
            ids, n = np.unique([vocabulary[w] for w in passage], return_counts=True)
            weight = n * idf[ids]
            if length := np.linalg.norm(weight):
                yield ids, weight / length


def randomised_svd(texts: DataFrame, vocabulary: dict[bytes, int], idf: np.ndarray, rank: int, rounds: int, seed: int) -> np.ndarray:
    """Orthonormal basis (words x rank) of the leading right singular vectors of the passages' TF-IDF matrix A.

    Tasks sum their passages' part of A'(A Q); parts are summed by word in a shuffle, and the driver
    orthonormalises words x rank numbers, as many as the block's vocabulary has. A last pass gives the singular values' order.
    """
    size = len(vocabulary)
    rank = min(rank, size)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, rank)))[0]

    def times(q: np.ndarray) -> np.ndarray:
        q32 = q.astype(np.float32)

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((size, rank))
            used = np.zeros(size, dtype=bool)
            for batch in batches:
                for ids, weight in _rows(batch["text"].tolist(), vocabulary, idf):
                    total[ids] += weight[:, None] * (weight @ q32[ids])
                    used[ids] = True
            at = np.flatnonzero(used)
            yield pd.DataFrame({"f": at, "v": pd.Series(total[at].tolist(), dtype=object)})  # a task may have no word

        # a word has one row a task at most
        parts = texts.select("text").mapInPandas(part, "f long, v array<double>").groupBy("f")
        summed = parts.agg(*[F.sum(F.get("v", i)).alias(f"v{i}") for i in range(rank)]).toPandas()
        out = np.zeros((size, rank))
        out[summed["f"].to_numpy(dtype=np.int64)] = summed.drop(columns="f").to_numpy()
        return out

    for _ in range(rounds):
        z = times(q)
        q = np.linalg.qr(z)[0]
    small = q.T @ times(q)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return q @ turn[:, np.argsort(-values)]


@dataclass(frozen=True)
class Passage:
    item: object
    words: int
    masks: dict
    answer: tuple
    size: int


def _passages(items: list[tuple[object, str]]) -> list[tuple[Passage, list[bytes]]]:
    out = []
    for key, text in items:
        words = words_of(text or "")
        parts = passages_of(words) if words else []
        for k, part in enumerate(parts):
            masks: dict[bytes, int] = {}
            for i, w in enumerate(part):
                masks[w] = masks.get(w, 0) | 1 << i
            size = next((s for s in SIZES if s >= len(part)), SIZES[-1])
            answer = tuple(answer_of(text)) if k == len(parts) - 1 else ()
            out.append((Passage(key, len(part), masks, answer, size), part))
    return out


def _holds(words: list[bytes], part: tuple) -> bool:
    n = len(part)
    return n > 0 and any(words[i] == part[0] and tuple(words[i : i + n]) == part for i in range(len(words) - n + 1))


class Index:
    """Passages of a block of items in the latent space, and the search for them in texts."""

    def __init__(self, items: list[tuple[object, str]], vocabulary: dict[bytes, int], idf: np.ndarray, basis: np.ndarray, cosine: float, cover: float, similarity: float, paraphrase: float, min_words: int):
        self.cosine, self.cover, self.similarity, self.paraphrase = cosine, cover, similarity, paraphrase
        self.vocabulary = vocabulary
        # a word's load: its idf times its latent coordinates; words of no item load nothing
        self.loads = np.vstack([idf[:, None] * basis, np.zeros((1, basis.shape[1]))]).astype(np.float32)
        made = [x for x in _passages(items) if x[0].words >= min_words]
        self.by_size = []
        for size in SIZES:
            own = [(p, part) for p, part in made if p.size == size]
            if own:
                x = np.stack([self.loads[[vocabulary[w] for w in part]].sum(axis=0) for _, part in own])
                length = np.maximum(np.linalg.norm(x, axis=1), 1e-9)
                self.by_size.append((size, [p for p, _ in own], (x / length[:, None]).T.copy(), (cover * length).astype(np.float32)))

    def search(self, texts: list[str | None]) -> list[list[tuple]]:
        """Leaks (item, similarity, cosine, answer) of each text."""
        out: list[list[tuple]] = [[] for _ in texts]
        group: list[tuple[int, list[bytes]]] = []
        held = 0
        for i, text in enumerate(texts):
            words = words_of(text or "")
            if words:
                group.append((i, words))
                held += len(words)
            if held > 100_000:
                self._group(group, out)
                group, held = [], 0
        if group:
            self._group(group, out)
        return out

    def _group(self, group: list[tuple[int, list[bytes]]], out: list[list[tuple]]) -> None:
        grid = SIZES[-1] // 4  # every text begins on the coarsest grid
        lengths = np.array([len(w) for _, w in group])
        begin = np.concatenate(([0], np.cumsum(-(-lengths // grid) * grid)))
        flat = np.full(begin[-1], len(self.loads) - 1, dtype=np.int32)
        place, other = self.vocabulary.get, len(self.loads) - 1
        for (_, words), b in zip(group, begin):
            flat[b : b + len(words)] = [place(w, other) for w in words]
        units = np.concatenate([self.loads[flat[a : a + 65536]].reshape(-1, UNIT, self.loads.shape[1]).sum(axis=1) for a in range(0, len(flat), 65536)])
        sums = np.zeros((len(units) + 1, units.shape[1]))
        np.cumsum(units, axis=0, dtype=np.float64, out=sums[1:])
        owner = np.repeat(np.arange(len(group)), np.diff(begin))[:: UNIT]
        stop = begin[1:][owner] // UNIT
        for size, passages, items, least in self.by_size:
            step = size // 4 // UNIT
            starts = np.arange(0, len(units), step)
            inside = starts < (begin[owner[starts]] + lengths[owner[starts]] + UNIT - 1) // UNIT
            starts = starts[inside]
            x = (sums[np.minimum(starts + size // UNIT, stop[starts])] - sums[starts]).astype(np.float32)
            length = np.maximum(np.linalg.norm(x, axis=1), 1e-12)
            for a in range(0, len(x), 8192):
                near = x[a : a + 8192] @ items
                rows, cols = np.nonzero((near >= self.cosine * length[a : a + 8192, None]) & (near >= least))
                if len(rows):
                    at = starts[a + rows]
                    self._verify(group, owner[at], at * UNIT - begin[owner[at]], cols, near[rows, cols] / length[a + rows], size, passages, out)

    def _verify(self, group, docs, at, cols, cosines, size, passages, out) -> None:
        order = np.lexsort((-cosines, cols, docs))
        done: tuple | None = None
        for k in order.tolist():
            d, c = int(docs[k]), int(cols[k])
            if done == (d, c):
                continue
            place, words = group[d]
            p = passages[c]
            said = words[max(0, int(at[k]) - size // 4) : int(at[k]) + size + size // 4]
            share = common_subsequence(p.masks, p.words, said) / p.words
            if share < self.paraphrase:
                continue
            answer = _holds(said, p.answer)
            if share >= self.similarity or answer:
                out[place].append((p.item, share, float(cosines[k]), answer))
                if share >= self.similarity:
                    done = (d, c)


def _search(shared, item_type: str):
    @F.pandas_udf(f"array<struct<item:{item_type},similarity:double,cosine:double,answer:boolean>>")
    def leaks(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("item", "similarity", "cosine", "answer"), x)) for x in own] for own in shared.value.search(texts.tolist())])

    return leaks


def leak_blocks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", docs_text: str = "text", rank: int = 64, rounds: int = 2, cosine: float = 0.0, cover: float = 0.4, similarity: float = 0.8, paraphrase: float = 0.6, min_words: int = 5, block: int = 5000, block_bytes: int = 8_000_000, seed: int = 5
) -> Iterator[tuple[Column, bool]]:
    """(column for ``docs``, whether it is the last) for each block of items; the column is an array of (item, similarity, cosine, answer), the items that the text leaks.

    Items come in blocks of about ``block`` rows and ``block_bytes`` bytes of text, whichever makes more; each block's words, index and latent space are
    broadcast while its column is in hand, and go when the next block is asked for, so use a column before that: one block is held at a time. The last block's stay.
    Each block is searched in all texts. IDF
    counts all rows of ``docs`` and of the block. The latent space is a randomised SVD of the TF-IDF
    matrix of all passages of the block, in Spark jobs. Windows of every text are candidates for a
    passage where their part along the passage is at least ``cover`` of its length, and their latent
    cosine is at least ``cosine`` (words around a passage lower it, so it is no test by default); then the longest common subsequence of words must cover
    ``similarity`` of the passage, or ``paraphrase`` of it with the item's answer (what follows its last
    question mark, or its last sentence) said word for word. Items of fewer than ``min_words`` words,
    and null ones, are never leaked; null texts leak nothing.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).where("text is not null")
    item_type = benchmark.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(docs_text).alias("text"))
    n_items, n_bytes = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n_items // block), -(-n_bytes // block_bytes))
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        own = [(r["item"], r["text"]) for r in part.collect()]  # about ``block`` rows, ``block_bytes`` bytes
        vocabulary = {w: i for i, w in enumerate(sorted({w for _, text in own for w in words_of(text)}))}
        if not vocabulary:
            continue
        n_df, n = document_frequencies(texts.union(part.select("text")), vocabulary)
        idf = np.log((1 + n) / (1 + n_df))
        basis = randomised_svd(part, vocabulary, idf, rank, rounds, seed)
        index = Index(own, vocabulary, idf, basis, cosine, cover, similarity, paraphrase, min_words)
        shared = spark.sparkContext.broadcast(index)
        yield _search(shared, item_type)(F.col(docs_text)), b == blocks - 1
        if b < blocks - 1:
            shared.unpersist()


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", **options) -> DataFrame:
    """(doc id, item id, similarity, cosine, answer): a row for each row of ``docs`` and each item that it leaks (see leak_blocks).

    Repeated rows and ids are searched each; repeated items count once for each text. Other columns
    are not read. Without docs or without items there are no rows.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    item_type = benchmark.schema[item_col].dataType.simpleString()
    scratch, found = Scratch(docs.sparkSession, "leaks"), []
    best = F.transform(
        F.array_distinct(F.transform("leaks", lambda x: x["item"])),
        lambda item: F.array_max(F.transform(F.filter("leaks", lambda x: x["item"].eqNullSafe(item)), lambda x: F.struct(x["similarity"], x["cosine"], x["answer"], x["item"]))),
    )
    for b, (column, _) in enumerate(leak_blocks(own, benchmark, item_col, item_text, **options)):
        leaks = own.select("id", F.md5("text").alias("key"), column.alias("leaks")).where(F.size("leaks") > 0)
        found.append(scratch.keep(leaks.select("id", "key", F.inline(best)), f"block-{b}"))
    if not found:
        return docs.sparkSession.createDataFrame([], f"`{id_col}` {own.schema['id'].dataType.simpleString()}, `{item_col}` {item_type}, similarity double, cosine double, answer boolean")
    rows = found[0]
    if len(found) > 1:
        # texts of one item can be in several blocks; rows of one id and text have the same leaks, as many times in each block
        told = F.max(F.struct("similarity", "cosine", "answer")).alias("best")
        parts = [part.groupBy("id", "key", "item").agg(F.count("*").alias("times"), told) for part in found]
        rows = reduce(DataFrame.unionByName, parts).groupBy("id", "key", "item").agg(F.max("times").alias("times"), F.max("best").alias("best"))
        rows = rows.select("id", "item", "best.*", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return rows.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "similarity", "cosine", "answer")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose text leaks no item (see leak_blocks), block after block; what all blocks but the last leave is written."""
    scratch = Scratch(docs.sparkSession, "unleaked")
    left, held = docs, None
    for b, (column, last) in enumerate(leak_blocks(docs, benchmark, item_col, item_text, text_col, **options)):
        left = left.where(F.size(column) == 0)
        if not last:
            left = scratch.keep(left, f"block-{b}")
            if held:
                scratch.drop(held)
            held = f"block-{b}"
    return left
