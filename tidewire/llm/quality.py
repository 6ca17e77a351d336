"""Quality classifier: a regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: End-of-sentence marks.
ENDS = (".", ",", ";", ":", "!", "?")
FEATURES = (
    "log_words", "log_word_length", "upper", "symbols", "exclamations", "bars", "digits",
    "distinct_words", "repeats", "short_words", "sentence_marks", "log_line_words", "distinct_lines", "top_word",
)


def _statistics(text: str) -> list[float]:
    """Raw statistics of one whole text; an empty text has zeros."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    chars = len(text)
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    table = np.bincount(raw, minlength=256)
    letters = sum(map(len, words))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    symbols = int(table[33:48].sum() + table[58:65].sum() + table[91:97].sum() + table[123:127].sum())
    marks = int(table[[ord(x) for x in ENDS]].sum())
    return [
        np.log1p(n),
        np.log1p(letters / n),
        int(table[65:91].sum()) / chars,
        (symbols - marks) / chars,
        int(table[33]) / chars,
        int(table[124]) / chars,
        int(table[48:58].sum()) / chars,
        len(counts) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        sum(len(w) <= 3 for w in words) / n,
        marks / n,
        np.log1p(n / max(1, len(lines))),
        len(set(lines)) / max(1, len(lines)),
        max(counts.values()) / n,
    ]


def document_vectors(texts: list[str | None]) -> np.ndarray:
    """Transformed statistics: shares go through a square root, which spreads the values near zero."""
    raw = np.array([_statistics(t or "") for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))
    shares = [i for i, name in enumerate(FEATURES) if not name.startswith("log_")]
    raw[:, shares] = np.sqrt(np.maximum(raw[:, shares], 0))
    return raw


def vectors(text: Column) -> Column:
    """document_vectors of a text column."""

    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        values = texts.tolist()
        return pd.Series([row for at in range(0, len(values), 500) for row in document_vectors(values[at : at + 500]).tolist()], dtype=object)

    return of(text)


@dataclass(frozen=True)
class QuadraticDiscriminant:
    """Per class: mean, inverse Cholesky factor of the shrunk covariance, and log weight."""

    means: np.ndarray
    whiteners: np.ndarray
    weights: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Posterior of class 1 from the difference of log densities."""
        logs = [w - 0.5 * (((x - m) @ white.T) ** 2).sum(axis=1) for m, white, w in zip(self.means, self.whiteners, self.weights, strict=True)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", shrinkage: float = 0.1, floor: float = 1e-3, vector_col: str | None = None) -> QuadraticDiscriminant:
    """Learns from every row of ``docs`` that has a label; ``vector_col`` names a column with its ``vectors``, if they are worked out.

    Moments are summed in tasks and then by (class, entry) in a shuffle: the driver gets two fixed-size
    sets of sums, whatever the number of rows. Covariances are shrunk towards the diagonal by
    ``shrinkage`` and their diagonal is raised by ``floor``. Null labels and ids count for nothing;
    a document with several labels takes the largest. A class has its own moments from one row on
    (the floor makes its covariance regular); a class without rows takes those of all rows; with no rows at all every score is one half.
    """
    d = len(FEATURES)
    size = 1 + d + d * d

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, size))
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                x, y = np.stack(part["vector"].tolist()), part["label"].to_numpy()
                for k in (0, 1):
                    own = x[y == k]
                    sums[k, 0] += len(own)
                    sums[k, 1 : 1 + d] += own.sum(axis=0)
                    sums[k, 1 + d :] += (own.T @ own).ravel()
        yield pd.DataFrame({"class": np.repeat([0, 1], size), "entry": np.tile(np.arange(size), 2), "value": sums.ravel()})

    marked = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    # vectors, not texts, go to the labels
    rows = docs.select(F.col(id_col).alias("id"), (F.col(vector_col) if vector_col else vectors(F.col(text_col))).alias("vector")).join(marked, "id").select("vector", "label")
    summed = rows.mapInPandas(moments, "class int, entry int, value double").groupBy("class", "entry").agg(F.sum("value").alias("value"))
    sums = np.zeros((2, size))
    for row in summed.collect():  # 2 * (1 + d + d * d) rows
        sums[row["class"], row["entry"]] = row["value"]
    if not sums[:, 0].sum():
        return QuadraticDiscriminant(np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2))
    both = sums.sum(axis=0)
    means, whiteners, weights = [], [], []
    for k in (0, 1):
        own = sums[k] if sums[k, 0] else both
        n = own[0]
        mean = own[1 : 1 + d] / n
        cov = own[1 + d :].reshape(d, d) / n - np.outer(mean, mean)
        cov = (1 - shrinkage) * cov + shrinkage * np.diag(np.diag(cov)) + floor * np.eye(d)
        lower = np.linalg.cholesky(cov)
        means.append(mean)
        whiteners.append(np.linalg.inv(lower))
        weights.append(np.log((sums[k, 0] + 1) / (both[0] + 2)) - np.log(np.diag(lower)).sum())
    return QuadraticDiscriminant(np.array(means), np.array(whiteners), np.array(weights))


def score(model: QuadraticDiscriminant, text: Column) -> Column:
    """Score from 0 to 1 of each whole text, null and empty ones too (they have zero statistics)."""
    return score_vectors(model, vectors(text))


def score_vectors(model: QuadraticDiscriminant, vector: Column) -> Column:
    """Score from 0 to 1 of each document vector."""

    @F.pandas_udf("double")
    def scored(rows: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.stack(rows.tolist())) if len(rows) else np.zeros(0))

    return scored(vector)
