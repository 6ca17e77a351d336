"""The driver's tables seen as a newsroom's: candidate stories, history, audit events; in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.session import read_table

NOW = "2024-01-30 00:00:00"


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as candidate stories: a title (the first 80 characters of the first line), a link, a score and a capture time."""
    docs = read_table(spark, sf_dir, "documents")
    title = F.substring(F.substring_index("text", "\n", 1), 1, 80)
    return docs.select(
        "doc_id",
        title.alias("title"),
        F.concat(F.lit("https://www."), "source", F.lit(".example.com/News/"), (F.col("doc_id") % 700).cast("string"), F.lit("/?utm_source=x&id=7")).alias("link"),
        "source",
        F.col("lang").alias("channel"),
        ((F.col("doc_id") * 37) % 101).cast("int").alias("score"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id * 41 % 43200 as int), 0)").alias("captured"),
        "n_chars",
    )


SQL = """WITH stories AS (
  SELECT doc_id, substr(split_part(text, chr(10), 1), 1, 80) AS title,
    'https://www.' || source || '.example.com/News/' || (doc_id % 700)::VARCHAR || '/?utm_source=x&id=7' AS link,
    source, lang AS channel, ((doc_id * 37) % 101)::INT AS score,
    TIMESTAMP '2024-01-01' + to_minutes((doc_id * 41) % 43200) AS captured, n_chars
  FROM documents)
"""

FOLD = "trim(regexp_replace(translate(lower({0}), 'áàâãäéèêëíìîïóòôõöúùûüçñ', 'aaaaaeeeeiiiiooooouuuucn'), '\\s+', ' ', 'g'))"
NORMAL = "trim(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g'))"
TOKENS = "list_sort(list_distinct(list_filter(string_split(coalesce(" + NORMAL + ", ''), ' '), lambda w: w <> '')))"
LINK_KEY = "regexp_replace(lower(regexp_replace(lower(regexp_extract({0}, '://([^/?#]*)', 1)), '^www\\.', '') || regexp_extract({0}, '://[^/?#]*([^?#]*)', 1)), '/+$', '')"
