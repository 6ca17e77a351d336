"""The corpus pipeline: five stages from raw documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import latent_search, line_dedup, packing, quality, simhash
from tidewire.llm.common import Scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    model = quality.fit(docs.where(~held_out), table(spark, sf_dir, "labels"))
    return docs.where(quality.score(model, F.col("text")) >= 0.7).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without chunks of lines, and lines of over 50 words together, that stand elsewhere; n_chars follows the text."""
    done = line_dedup.dedup_lines(docs.select(*COLUMNS), passage_words=50)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: SimHash over five-word shingles, deletion keys, then Jaccard similarity 0.8 or more."""
    return simhash.drop_near_duplicates(docs.select(*COLUMNS), width=5, similarity=0.8)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark passage."""
    return latent_search.without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 1024 tokens."""
    return packing.pack(packing.tokenize_pieces(docs)).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("simhash", keep_one_of_near_copies),
    ("decontamination", drop_leaked),
    ("packing", pack_sequences),
]

#: The stages need models, XXH64 and a tokenizer, which SQL has not; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
