"""Queues from tables of any columns: documents seen under two sets of names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import schemas
from tidewire.plans.registry import query
from tidewire.session import read_table

SLUG = r"trim(regexp_replace(regexp_replace(regexp_extract(link, '([^/?#]+)/*(?:[?#].*)?$', 1), '\.[a-z]{2,5}$', ''), '[-_]+', ' ', 'g'))"
QUEUE = f"""WITH d AS (SELECT doc_id, doc_id % 2 = 0 AS even, 'https://WWW.' || source || '.example.com/news/a-b_' || doc_id || '.html?x=1' AS link, CASE WHEN doc_id % 7 = 0 THEN ' ' WHEN doc_id % 11 = 0 THEN 'http://x' ELSE trim(substr(split_part(text, chr(10), 1), 1, 80)) END AS title0,
  CASE WHEN doc_id % 5 <> 0 THEN nullif(trim(text), '') END AS said, CASE WHEN doc_id % 3 = 0 THEN 'i' || doc_id END AS image, CASE WHEN doc_id % 4 = 0 THEN 'Geral' ELSE source END AS src, doc_id % 13 = 0 AS closed, doc_id % 17 = 0 AS hidden FROM documents),
a AS (SELECT *, coalesce(length(said), 0) AS chars, nullif(trim(title0), '') AS title1 FROM d WHERE NOT (even AND closed) AND NOT (NOT even AND hidden))
SELECT doc_id, CASE WHEN title1 IS NULL OR starts_with(title1, 'http') OR (contains(title1, '/') AND length(title1) > 120) THEN {SLUG} ELSE title1 END AS title, CASE WHEN even AND src = 'Geral' THEN source_host ELSE src END AS source,
  CASE WHEN chars >= 550 THEN 'ok' WHEN chars > 0 THEN 'short' ELSE 'pending' END AS state, CASE WHEN chars >= 550 THEN 90 WHEN chars > 0 THEN 70 ELSE 35 END + CASE WHEN image IS NULL THEN 0 WHEN chars > 0 THEN 10 ELSE 25 END AS score,
  CASE WHEN chars >= 550 THEN 5000 WHEN chars > 0 THEN 1000 ELSE 0 END + CASE WHEN image IS NULL THEN 0 ELSE 1000 END AS rank FROM (SELECT *, lower(regexp_replace(regexp_extract(link, '://([^/?#:]+)', 1), '(?i)^www\\.', '')) AS source_host FROM a)""".replace("\\\\", "\\")


@query(QUEUE.replace("CASE WHEN even AND src = 'Geral'", "CASE WHEN src = 'Geral'"))
def queue_from_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The active rows of two queues with different columns, under one set of names, with their state, score and rank."""
    c = F.col
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("https://WWW."), "source", F.lit(".example.com/news/a-b_"), "doc_id", F.lit(".html?x=1")).alias("link"),
        F.when(c("doc_id") % 7 == 0, " ").when(c("doc_id") % 11 == 0, "http://x").otherwise(F.substring(F.substring_index("text", "\n", 1), 1, 80)).alias("title"),
        F.when(c("doc_id") % 5 != 0, c("text")).alias("said"), F.when(c("doc_id") % 3 == 0, F.concat(F.lit("i"), "doc_id")).alias("image"),
        F.when(c("doc_id") % 4 == 0, "Geral").otherwise(c("source")).alias("src"), (c("doc_id") % 13 == 0).alias("closed"), (c("doc_id") % 17 == 0).alias("hidden"),
    )
    even, odd = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 <> 0")
    one = even.select("doc_id", c("link").alias("link_origem"), c("title").alias("titulo"), c("said").alias("raw_source_text"), c("image").alias("thumb"), c("src").alias("fonte"), F.when(c("closed"), "Publicada").alias("status"))
    two = odd.select("doc_id", c("link").alias("url_final"), F.lit("").alias("headline"), c("title").alias("titulo_origem"), F.lit(" ").alias("dossie"), c("said").alias("texto_fonte"), c("image").alias("image"), c("src").alias("nome_fonte"), F.when(c("hidden"), "sim").alias("oculta"))
    rows = [schemas.queue_rows(t).select("doc_id", c("queue_title").alias("title"), c("queue_source").alias("source"), c("queue_state").alias("state"), c("queue_score").alias("score"), c("queue_rank").alias("rank")) for t in (one, two)]
    return rows[0].union(rows[1])


@query("""SELECT event_id, coalesce(user_id, 0) AS user_id, coalesce(event_type, 'none') AS event_type, true AS checked, coalesce((props::JSON ->> 'k')::BIGINT, 65) AS k, 'pt' AS lang, coalesce(value, 0.0) AS weight FROM events""")
def completed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows of one schema: missing fields and nested ones get its defaults, others go."""
    events = read_table(spark, sf_dir, "events")
    nested = events.select("event_id", "user_id", "event_type", F.struct(F.from_json("props", "k long")["k"].alias("k"), F.lit(1).alias("outside")).alias("props"), F.col("value").alias("weight"), "ts")
    defaults = {"event_id": 0, "user_id": 0, "event_type": "none", "checked": True, "props": {"k": 65, "more": {"lang": "pt"}}, "weight": 0.0}
    made = schemas.complete_rows(nested, defaults)
    return made.select("event_id", "user_id", "event_type", "checked", "props.k", "props.more.lang", "weight")
