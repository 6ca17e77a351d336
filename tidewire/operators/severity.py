"""Severity of texts: hashed TF-IDF features and a multilayer perceptron of Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit(df: DataFrame, text: str, label: str, classes: int, key: str, features: int = 384, hidden: tuple[int, ...] = (128, 64), rounds: int = 40, sample: int = 20000, seed: int = 7) -> PipelineModel:
    """Model of the label (0 to ``classes`` - 1) from about ``sample`` labelled rows, those with the least hash of their key, or all if there are fewer.

    The bound is on the network's training rows, which it reads in every round; the rows stay in the
    tasks where they are. Null labels are left out and null texts read as empty.
    """
    rows = df.where(F.col(label).isNotNull())
    n = rows.count()
    if n > sample:
        rows = rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < (1 << 30) * sample // n)
    rows = rows.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(label).cast("double").alias("label"))
    stages = [
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\s+", toLowercase=True),
        HashingTF(inputCol="words", outputCol="counts", numFeatures=features),
        IDF(inputCol="counts", outputCol="weights"),
        Normalizer(inputCol="weights", outputCol="features"),
        MultilayerPerceptronClassifier(layers=[features, *hidden, classes], maxIter=rounds, seed=seed, blockSize=64),
    ]
    return Pipeline(stages=stages).fit(rows)


def predict(model: PipelineModel, df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, severity, probability) of every row: the likeliest class, the first on ties, and its probability."""
    rows = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    scored = model.transform(rows).select(key, F.col("prediction").cast("int").alias("severity"), vector_to_array("probability").alias("p"))
    return scored.select(key, "severity", F.array_max("p").alias("probability"))
