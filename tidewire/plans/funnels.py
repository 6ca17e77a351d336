"""The ingestion funnel over candidate stories: stages, quotas, caps, merges and ordered dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import text, urls
from tidewire.operators import dedup, funnel, history
from tidewire.plans.registry import query
from tidewire.plans.stories import LINK_KEY, NOW, SQL, stories
from tidewire.session import read_table, saved


@query(SQL + f""", s AS (SELECT CASE WHEN trim(title) = '' THEN 'no_title' WHEN toxic = 1 THEN 'blocked' WHEN date_diff('microsecond', captured, TIMESTAMP '{NOW}') / 3600000000.0 > 600 THEN 'too_old'
  WHEN contains(lower(title), 'worthless') THEN 'noise' WHEN score < 55 THEN 'low_score' ELSE 'accepted' END AS stage, source FROM stories LEFT JOIN labels USING (doc_id))
SELECT stage, count(*) AS n, count(DISTINCT source) AS sources FROM s GROUP BY stage""")
def funnel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories by the first stage of the funnel that rejects them."""
    rows = stories(spark, sf_dir).join(read_table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    age = F.expr(f"timestampdiff(MICROSECOND, captured, timestamp_ntz'{NOW}') / 3600000000D")
    stages = (
        ("no_title", F.trim("title") == ""), ("blocked", F.col("toxic") == 1), ("too_old", age > 600),
        ("noise", F.contains(F.lower("title"), F.lit("worthless"))), ("low_score", F.col("score") < 55),
    )
    return funnel.first_stage(rows, *stages).groupBy("stage").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


@query(SQL + """, o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY captured, doc_id) AS place FROM stories)
SELECT doc_id, source, score < 55 AS promoted FROM o WHERE score >= 55 OR place <= 2""")
def minimum_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong stories, and weak ones while their source has fewer than two accepted."""
    rows = stories(spark, sf_dir).select("doc_id", "source", "score", "captured")
    return funnel.minimum_quota(rows, "source", (F.col("captured"), F.col("doc_id")), F.col("score") >= 55).select("doc_id", "source", "promoted")


@query(SQL + """, o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY captured DESC, doc_id) AS r FROM stories)
SELECT doc_id, source FROM o WHERE r <= 12 ORDER BY captured DESC, doc_id LIMIT 120""")
def run_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stories that one run takes: twelve of a source and 120 in all (the size of a run is the feature)."""
    rows = stories(spark, sf_dir).select("doc_id", "source", "captured")
    return funnel.run_caps(rows, "source", 12, 120, F.desc("captured"), F.col("doc_id")).select("doc_id", "source")


@query(r"""WITH u AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\.', '') AS name FROM pages),
s AS (SELECT * FROM u WHERE contains(url, 'utm_source') AND contains(url, '/es/')), us AS (SELECT DISTINCT lower(regexp_replace(trim(url), '/+$', '')) AS k FROM s), ns AS (SELECT DISTINCT name FROM s WHERE name <> '')
SELECT page_id, us.k IS NOT NULL OR ns.name IS NOT NULL AS removed FROM u LEFT JOIN us ON lower(regexp_replace(trim(url), '/+$', '')) = us.k LEFT JOIN ns USING (name)""")
def source_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that a list of special sources (the tracked Spanish pages) names by address or by name."""
    rows = read_table(spark, sf_dir, "pages").select("page_id", "url", urls.host(F.col("url")).alias("name"))
    return funnel.without_sources(rows, rows.where("contains(url, 'utm_source') and contains(url, '/es/')"), "url", "name").select("page_id", "removed")


@query(SQL + f""", k AS (SELECT *, {LINK_KEY.format('link')} AS key FROM stories)
SELECT key, arg_min(title, doc_id) FILTER (title <> '') AS title, max(score) AS score, max(n_chars) AS n_chars, array_to_string(list_sort(list(DISTINCT source)), ',') AS origins FROM k WHERE key <> '' GROUP BY key""")
def config_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a key: the first title that is not empty, the greatest numbers and every origin."""
    rows = stories(spark, sf_dir).where(urls.key(F.col("link")) != "")
    merged = funnel.merge_configs(rows, urls.key(F.col("link")), ["title"], ["score", "n_chars"], "source", F.col("doc_id"))
    return merged.withColumn("origins", F.array_join("origins", ","))


@query("""WITH j AS (SELECT event_id, user_id, ts, event_type = 'purchase' AS urgent FROM events), p AS (SELECT user_id, max((ts, event_id)) FILTER (urgent) AS p, min((ts, event_id)) AS n FROM j GROUP BY user_id)
SELECT j.event_id, j.user_id, urgent FROM j JOIN p ON j.user_id IS NOT DISTINCT FROM p.user_id AND (j.ts, j.event_id) = coalesce(p.p, p.n)""")
def job_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One queued job a key: the last urgent one, else the first."""
    rows = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.col("event_type") == "purchase").alias("urgent"))
    return funnel.queue_jobs(rows, "user_id", F.col("urgent"), F.col("ts"), F.col("event_id")).select("event_id", "user_id", "urgent")


@query("""WITH f AS (SELECT event_id, ts, substr(sha256(event_type || '|' || user_id::VARCHAR || '|' || floor(value / 10)::BIGINT::VARCHAR), 1, 20) AS finding FROM events WHERE event_type = 'error'),
k AS (SELECT DISTINCT finding FROM f WHERE ts < TIMESTAMP '2024-01-15') SELECT event_id, finding, k.finding IS NOT NULL AS known FROM f LEFT JOIN k USING (finding) WHERE ts >= TIMESTAMP '2024-01-15'""")
def baseline_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings after the baseline, known or new by their key."""
    key = F.concat_ws("|", "event_type", F.col("user_id").cast("string"), F.floor(F.col("value") / 10).cast("string"))
    rows = read_table(spark, sf_dir, "events").where("event_type = 'error'")
    base = rows.where("ts < timestamp_ntz'2024-01-15 00:00:00'").select(F.substring(F.sha2(key, 256), 1, 20).alias("finding"))
    return funnel.split_known(rows.where("ts >= timestamp_ntz'2024-01-15 00:00:00'"), base, key).select("event_id", "finding", "known")


@query("""WITH s AS (SELECT doc_id, nullif(lang, 'es') AS lang, nullif(source, 'src3') AS source FROM documents), o AS (SELECT doc_id, 'xx' AS lang, 'label' || quality::VARCHAR AS source FROM labels)
SELECT s.doc_id, coalesce(nullif(s.lang, ''), o.lang) AS lang, coalesce(nullif(s.source, ''), o.source) AS source FROM s LEFT JOIN o USING (doc_id)""")
def field_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty fields take another list's value; filled ones stay."""
    left = read_table(spark, sf_dir, "documents").select("doc_id", F.nullif("lang", F.lit("es")).alias("lang"), F.nullif("source", F.lit("src3")).alias("source"))
    right = read_table(spark, sf_dir, "labels").select("doc_id", F.lit("xx").alias("lang"), F.concat(F.lit("label"), F.col("quality").cast("string")).alias("source"))
    return history.fill_empty(left, right, "doc_id", ["lang", "source"])


@query(SQL + f""", r AS (SELECT *, greatest(score, least(100, 50 + CASE WHEN n_chars >= 1500 THEN 20 ELSE 0 END + CASE WHEN channel = 'en' THEN 10 ELSE 0 END + CASE WHEN title <> '' THEN 5 ELSE 0 END))::INT AS total, {LINK_KEY.format('link')} AS key FROM stories),
d AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY total DESC, captured DESC, doc_id) AS r FROM r WHERE key <> '')
SELECT doc_id, total FROM d WHERE r = 1 AND date_diff('microsecond', captured, TIMESTAMP '{NOW}') / 3600000000.0 <= 700 AND total >= 65 ORDER BY total DESC, captured DESC, doc_id LIMIT 30""")
def combined_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cycle: rescored stories, the best of each key, inside the window, of 65 or more; the first thirty (the size of a cycle)."""
    parts = 50 + F.when(F.col("n_chars") >= 1500, 20).otherwise(0) + F.when(F.col("channel") == "en", 10).otherwise(0) + F.when(F.col("title") != "", 5).otherwise(0)
    rows = stories(spark, sf_dir).select("doc_id", "link", "captured", F.greatest("score", F.least(parts, F.lit(100))).alias("total"))
    best = dedup.keep_best(rows, urls.key(F.col("link")), -F.col("total"), -F.expr("unix_micros(cast(captured as timestamp))"), F.col("doc_id"))
    age = F.expr(f"timestampdiff(MICROSECOND, captured, timestamp_ntz'{NOW}') / 3600000000D")
    kept = best.where((age <= 700) & (F.col("total") >= 65))
    return kept.orderBy(F.desc("total"), F.desc("captured"), "doc_id").limit(30).select("doc_id", "total")


@query()
def greedy_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories that an ordered pass keeps: none like an earlier kept one; an iteration, tested against the plain pass."""
    rows = stories(spark, sf_dir).select("doc_id", text.tokens(F.col("title")).alias("ts"))
    leaders = saved(rows.where(F.size("ts") > 0).groupBy("ts").agg(F.min("doc_id").alias("id")))
    pairs = dedup.similar_pairs(leaders, "id", "ts", 0.65)
    kept = dedup.greedy_leaders(leaders.select("id"), pairs, lambda df, name: saved(df))
    return kept.select(F.col("id").alias("doc_id"))
