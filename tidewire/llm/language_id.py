"""Language identification: presence kernels of blended n-grams, Nyström landmarks, one-versus-rest kernel ridge regression."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import bounded_batches

#: N-grams of 1 to LONGEST characters fall into 2**BITS buckets.
LONGEST, BITS = 4, 18
#: Multipliers of the n-gram hash.
ROLL, MIX = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter or a mark on one."""
    return np.array([unicodedata.category(chr(i))[0] in "LM" for i in range(0x110000)])


def has_letter(text: str) -> bool:
    return any(unicodedata.category(c)[0] == "L" for c in text)


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def _grams(codes: np.ndarray) -> np.ndarray:
    """Distinct buckets of the n-grams of a row of characters."""
    found, rolled = [], np.zeros(len(codes) + 1, dtype=np.uint32)
    for n in range(1, min(LONGEST, len(codes)) + 1):
        rolled = (rolled[:-1] + codes[n - 1 :] + np.uint32(n)) * ROLL
        found.append((rolled ^ (rolled >> np.uint32(15))) * MIX >> np.uint32(32 - BITS))
    return _distinct(np.concatenate(found))


def presence(text: str, piece: int = 1 << 20) -> np.ndarray:
    """The buckets that the n-grams of a whole text fall into, each once, in order.

    Letters are lower-cased, everything between words is one space, and one space stands at either
    end. Long texts are read piece by piece; the last characters of a piece go before the next.
    """
    found, carried, within = [], np.array([32], dtype=np.uint32), False
    for at in range(0, len(text), piece):
        codes = np.frombuffer(text[at : at + piece].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letters = _letters()[codes]
        stays = letters.copy()
        stays[1:] |= letters[:-1]  # the first mark behind a word is its space
        stays[:1] |= within
        within = bool(letters[-1])
        last = [32] if within and at + piece >= len(text) else []
        own = np.concatenate([carried, np.where(letters, codes, np.uint32(32))[stays], np.array(last, dtype=np.uint32)])
        found.append(_grams(own))
        carried = own[-(LONGEST - 1) :]
    return found[0] if len(found) == 1 else _distinct(np.concatenate([*found, np.zeros(0, dtype=np.uint32)]))


def _products(buckets: list[np.ndarray], matrix: np.ndarray) -> np.ndarray:
    """Presence rows times a matrix with a row for each bucket: the product of a batch, without the zeros of the presence."""
    out = np.zeros((len(buckets), matrix.shape[1]))
    for i, own in enumerate(buckets):
        if len(own):
            out[i] = matrix[own].sum(axis=0, dtype=np.float64)
    return out


def _lengths(buckets: list[np.ndarray]) -> np.ndarray:
    return np.sqrt(np.array([max(1, len(x)) for x in buckets], dtype=np.float64))


@dataclass(frozen=True)
class StringKernelModel:
    """One-versus-rest ridge functions. The kernel is a product of presences, so landmarks times coefficients
    is one matrix of buckets by languages, and a batch is scored by one product with it."""

    languages: list[str]
    used: np.ndarray  # row of each bucket in ``weights``; the last row is of buckets that no landmark has
    weights: np.ndarray
    bias: np.ndarray

    def outputs(self, buckets: list[np.ndarray]) -> np.ndarray:
        return _products([self.used[x] for x in buckets], self.weights) / _lengths(buckets)[:, None] + self.bias

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text."""
        rows = [(i, presence(t)) for i, t in enumerate(texts) if t and has_letter(t)] if self.languages else []
        out = [(UNKNOWN, 0.0)] * len(texts)
        if rows:
            found = self.outputs([x for _, x in rows])
            for (i, _), own in zip(rows, found):
                out[i] = (self.languages[best := int(own.argmax())], round(float(np.clip((own[best] + 1) / 2, 0, 1)), 6))
        return out


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", landmarks: int = 128, ridge: float = 1e-3, batch: int = 256) -> StringKernelModel:
    """Learns from all rows of ``docs`` whose language is not null and whose text has a letter.

    The kernel of two texts is the number of buckets that both have over the root of the product of
    their numbers of buckets. ``landmarks`` texts are drawn, as many for each language (one at least):
    those with the smallest hash of the text, so copies are drawn once. Only their presence bits reach
    the driver, 32 KB each. The normal equations of ridge regression on the landmarks' kernels are summed
    over all learned rows in Spark, each language weighing the same; the driver gets landmarks x
    (landmarks + languages) sums, whatever the number of rows. A row of the driver's for each
    language means that the number of languages, not of rows, is taken to be small. Without rows
    to learn from, no language is known and every text is ``und``.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text rlike '\\\\p{L}'")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return StringKernelModel([], np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    each = max(1, landmarks // len(languages))
    hashed = rows.select("lang", F.xxhash64("text").alias("hash"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    chosen = [(r["lang"], r["hash"]) for r in hashed.distinct().withColumn("nth", nth).where(F.col("nth") <= each).collect()]  # about ``landmarks`` rows
    drawn = rows.withColumn("hash", F.xxhash64("text")).where(F.col("hash").isin([h for _, h in chosen]))

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()
        for part in batches:
            for lang, text, hash_ in part.itertuples(index=False):
                if (lang, hash_) in wanted and (lang, hash_) not in seen:
                    seen.add((lang, hash_))
                    flags = np.zeros(1 << BITS, dtype=bool)
                    flags[presence(text)] = True
                    yield pd.DataFrame({"lang": [lang], "hash": [hash_], "bits": [np.packbits(flags).tobytes()]})

    wanted = set(chosen)
    marks = drawn.mapInPandas(bits, "lang string, hash long, bits binary").groupBy("lang", "hash").agg(F.min("bits").alias("bits")).orderBy("lang", "hash").collect()
    held = np.array([np.unpackbits(np.frombuffer(r["bits"], dtype=np.uint8)) for r in marks])  # landmarks x buckets
    used = np.flatnonzero(held.any(axis=0))
    row_of = np.full(1 << BITS, len(used), dtype=np.int32)
    row_of[used] = np.arange(len(used))
    own = np.vstack([held[:, used].T, np.zeros((1, len(held)), dtype=np.uint8)])  # buckets x landmarks, and a row of zeros
    size = np.sqrt(held.sum(axis=1, dtype=np.float64))
    shared = spark.sparkContext.broadcast((own, row_of, size, languages))
    weight = {lang: sum(counts.values()) / len(languages) / n for lang, n in counts.items()}
    m, c = len(held), len(languages)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, row_of, size, languages = shared.value
        number = {lang: i for i, lang in enumerate(languages)}
        sums = np.zeros((m + 1, m + 1 + c))
        for whole in batches:
            for at in range(0, len(whole), batch):
                part = whole.iloc[at : at + batch]
                buckets = [presence(t) for t in part["text"].tolist()]
                kernels = _products([row_of[x] for x in buckets], own) / _lengths(buckets)[:, None] / size
                kernels = np.hstack([kernels, np.ones((len(part), 1))])
                targets = np.full((len(part), c), -1.0)
                targets[np.arange(len(part)), [number[x] for x in part["lang"]]] = 1
                by = np.array([weight[x] for x in part["lang"]])[:, None]
                sums += kernels.T @ (by * np.hstack([kernels, targets]))
        yield pd.DataFrame({"entry": range(m + 1), "sums": list(sums)})

    summed = rows.mapInPandas(moments, "entry int, sums array<double>").groupBy("entry").agg(*[F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(m + 1 + c)])
    total = np.array([list(r)[1:] for r in summed.orderBy("entry").collect()])
    shared.unpersist()
    among = np.zeros((m + 1, m + 1))
    among[:m, :m] = (own.T.astype(np.float64) @ own) / size / size[:, None]
    n = sum(counts.values())
    solved = np.linalg.solve(total[:, : m + 1] + ridge * n * among + 1e-9 * n * np.eye(m + 1), total[:, m + 1 :])
    return StringKernelModel(languages, row_of, own @ (solved[:m] / size[:, None]), solved[m])


def predict(model: StringKernelModel, text: Column, batch: int = 256) -> Column:
    """struct(lang_pred, score) of each whole text: ``und`` and 0 where it is null or has no letter."""

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def of(texts: pd.Series) -> pd.DataFrame:
        values = texts.tolist()
        rows = [x for at in range(0, len(values), batch) for x in model.predict(values[at : at + batch])]
        return pd.DataFrame(rows, columns=["lang_pred", "score"])

    return of(text)
