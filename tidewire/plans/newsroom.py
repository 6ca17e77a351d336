"""Windows, gates, dedup, history and ranking over candidate stories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import dates, text, urls
from tidewire.operators import classify, dedup, history, ranking
from tidewire.plans.registry import query
from tidewire.plans.stories import LINK_KEY, NORMAL, NOW, SQL, TOKENS, stories
from tidewire.session import read_table

QUOTAS = {"es": 30, "de": 20}


@query(f"""SELECT event_id, CASE WHEN age < -1/6.0 THEN 'future' WHEN age > 72 THEN 'too_old' ELSE 'in_window' END AS reason,
  age >= -1/6.0 AND age <= 72 AS ok, round(age, 4) AS age_h
FROM (SELECT event_id, date_diff('microsecond', ts, TIMESTAMP '{NOW}') / 3600000000.0 AS age FROM events)""")
def window_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publication window with ordered reasons."""
    rows = read_table(spark, sf_dir, "events").select("event_id", dates.window_verdict("ts", NOW, 72).alias("v"))
    return rows.select("event_id", "v.reason", "v.ok", F.round("v.age", 4).alias("age_h"))


@query(f"""SELECT event_type, count(*) AS n FROM events WHERE ts IS NULL OR date_diff('microsecond', ts, TIMESTAMP '{NOW}') / 3600000000.0 <= 240 GROUP BY 1""")
def lenient_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a date pass; counts of those inside by type."""
    return read_table(spark, sf_dir, "events").where(dates.lenient_window("ts", NOW, 240)).groupBy("event_type").agg(F.count("*").alias("n"))


@query(SQL + f"""SELECT doc_id, CASE WHEN age <= 1 THEN 3 WHEN age <= 2 THEN 2 WHEN age <= 240 THEN 1 ELSE 0 END AS priority
FROM (SELECT doc_id, date_diff('microsecond', captured, TIMESTAMP '{NOW}') / 3600000000.0 AS age FROM stories)""")
def age_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stories(spark, sf_dir).select("doc_id", dates.age_priority("captured", NOW, 240).alias("priority"))


NEGATIVE, POSITIVE = ("worthless", "token", "!!"), ("the ", "licensed")


@query(SQL + """SELECT doc_id, list_filter(['worthless', 'token', '!!'], lambda t: contains(lower(title), t))[1:3]::VARCHAR AS found
FROM stories WHERE len(list_filter(['worthless', 'token', '!!'], lambda t: contains(lower(title), t))) > 0
  AND len(list_filter(['the ', 'licensed'], lambda t: contains(lower(title), t))) = 0 OR trim(title) = ''""")
def noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with a negative term and no positive one, and blank ones."""
    low = F.lower("title")
    bad, good = text.hits(low, NEGATIVE), text.hits(low, POSITIVE)
    rows = stories(spark, sf_dir).where(((F.size(bad) > 0) & (F.size(good) == 0)) | (F.trim("title") == ""))
    return rows.select("doc_id", F.concat(F.lit("["), F.array_join(F.slice(bad, 1, 3), ", "), F.lit("]")).alias("found"))


@query("""SELECT doc_id, CASE WHEN n_chars < 300 THEN 'too_short' WHEN toxic = 1 THEN 'invalid_status' WHEN quality = 0 THEN 'snippet' ELSE 'ok' END AS verdict
FROM documents LEFT JOIN labels USING (doc_id)""")
def source_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered source checks: length, status, snippet method."""
    rows = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(read_table(spark, sf_dir, "labels"), "doc_id", "left")
    steps = ((F.col("n_chars") < 300, "too_short"), (F.col("toxic") == 1, "invalid_status"), (F.col("quality") == 0, "snippet"))
    return rows.select("doc_id", classify.gate(*steps).alias("verdict"))


@query(SQL + """SELECT doc_id, link, CASE WHEN score >= 90 THEN 'publish' WHEN score >= 80 THEN 'draft' WHEN score >= 65 THEN 'review' ELSE 'drop' END AS tier FROM stories""")
def publication_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("score")
    tier = classify.gate((score >= 90, "publish"), (score >= 80, "draft"), (score >= 65, "review"), passed="drop")
    return stories(spark, sf_dir).select("doc_id", "link", tier.alias("tier"))


@query(SQL + f""", keyed AS (SELECT *, {LINK_KEY.format('link')} AS k FROM stories),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, captured DESC, doc_id) AS r FROM keyed WHERE k <> '')
SELECT doc_id, link, score FROM o WHERE r = 1""")
def keyed_dedup_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One story a URL key: best score, later capture, first id; empty keys go."""
    rows = stories(spark, sf_dir).select("doc_id", "link", "score", "captured")
    late = -F.expr("unix_micros(cast(captured as timestamp))")
    return dedup.keep_best(rows, urls.key(F.col("link")), -F.col("score"), late, F.col("doc_id")).select("doc_id", "link", "score")


@query(SQL + f""", keyed AS (SELECT *, substr(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]', '', 'g'), 1, 180) AS k FROM stories),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS r FROM keyed)
SELECT doc_id, title FROM o WHERE r = 1 OR k = ''""")
def keyed_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First story a title key; rows with empty keys all stay."""
    rows = stories(spark, sf_dir).select("doc_id", "title")
    return dedup.keep_best(rows, text.title_key(F.col("title")), F.col("doc_id"), drop_empty=False)


@query(SQL + f""", sets AS (SELECT ts, min(doc_id) AS id FROM (SELECT doc_id, {TOKENS.format('title')} AS ts FROM stories) WHERE len(ts) > 0 GROUP BY ts),
p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.ts, b.ts)) AS s, len(a.ts) + len(b.ts) AS n FROM sets a JOIN sets b ON a.id < b.id)
SELECT a, b, round(s / (n - s), 6) AS similarity FROM p WHERE s / (n - s) >= 0.65""")
def similar_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of title classes whose token sets have a Jaccard similarity of 0.65 or more."""
    rows = stories(spark, sf_dir).select("doc_id", text.tokens(F.col("title")).alias("ts"))
    return dedup.similar_pairs(rows, "doc_id", "ts", 0.65).withColumn("similarity", F.round("similarity", 6))


@query(SQL + f""", blocked AS (SELECT doc_id FROM labels WHERE toxic = 1), discarded AS (SELECT doc_id FROM labels WHERE quality = 0),
running AS (SELECT DISTINCT user_id AS doc_id FROM events WHERE event_type = 'purchase'),
known AS (SELECT DISTINCT {NORMAL.format('text')} AS k FROM benchmark)
SELECT CASE WHEN b.doc_id IS NOT NULL THEN 'blocked' WHEN k.k IS NOT NULL THEN 'published' WHEN d.doc_id IS NOT NULL THEN 'discarded' WHEN r.doc_id IS NOT NULL THEN 'in_process' ELSE 'new' END AS outcome, count(*) AS n
FROM stories s LEFT JOIN blocked b USING (doc_id) LEFT JOIN known k ON k.k = {NORMAL.format('title')} LEFT JOIN discarded d USING (doc_id) LEFT JOIN running r USING (doc_id) GROUP BY 1""")
def reject_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the ordered rejections against history."""
    labels = read_table(spark, sf_dir, "labels")
    rows = stories(spark, sf_dir).withColumn("normal", text.normal_title(F.col("title")))
    checks = (
        ("blocked", labels.where("toxic = 1").select("doc_id"), "doc_id"),
        ("published", read_table(spark, sf_dir, "benchmark").select(text.normal_title(F.col("text")).alias("k")), "normal"),
        ("discarded", labels.where("quality = 0").select("doc_id"), "doc_id"),
        ("in_process", read_table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id"), "doc_id"),
    )
    return history.reject_in_order(rows, checks).groupBy(F.coalesce("rejected", F.lit("new")).alias("outcome")).agg(F.count("*").alias("n"))


@query(SQL + """, p AS (SELECT *, score >= 65 AS inn FROM stories),
q AS (SELECT *, CASE channel WHEN 'es' THEN 30 WHEN 'de' THEN 20 ELSE 0 END - sum(inn::INT) OVER (PARTITION BY channel) AS missing,
  row_number() OVER (PARTITION BY channel, inn ORDER BY score DESC, doc_id) AS r FROM p),
k AS (SELECT *, NOT inn AS topped FROM q WHERE inn OR r <= missing),
c AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY score DESC, doc_id) AS rc FROM k),
d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rs FROM c WHERE rc <= 25 OR topped)
SELECT doc_id, title, channel, source, score, topped FROM d WHERE rs <= 4""")
def ranked_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue: stories of 65 or more, channels topped up to their quota, a cap by channel and then by source."""
    order = (F.desc("score"), F.col("doc_id"))
    rows = ranking.with_quota(stories(spark, sf_dir), F.col("score") >= 65, "channel", QUOTAS, *order)
    return ranking.cascaded_caps(rows, "channel", 25, "source", 4, *order).select("doc_id", "title", "channel", "source", "score", "topped")


@query(SQL + f""", q AS (SELECT doc_id, title, 0 AS side, {LINK_KEY.format('link')} AS k FROM stories WHERE score >= 90
  UNION ALL SELECT doc_id, title, 1, {LINK_KEY.format('link')} FROM stories WHERE score < 90 AND score >= 50),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY side, doc_id) AS r FROM q WHERE k <> '')
SELECT doc_id, title, side FROM o WHERE r = 1""")
def queue_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue rows go before candidates of the same key."""
    rows = stories(spark, sf_dir).where("score >= 50").select("doc_id", "title", F.when(F.col("score") >= 90, 0).otherwise(1).alias("side"), "link")
    return dedup.keep_best(rows, urls.key(F.col("link")), F.col("side"), F.col("doc_id")).select("doc_id", "title", "side")


@query(SQL + """, old AS (SELECT doc_id, score, CASE WHEN doc_id % 7 = 0 THEN 'deleted' ELSE 'captured' END AS status FROM stories WHERE doc_id % 2 = 0),
new AS (SELECT doc_id, score + 1 AS score, 'captured' AS status FROM stories WHERE doc_id % 3 = 0)
SELECT * FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new) OR status = 'deleted'
UNION ALL SELECT * FROM new WHERE doc_id NOT IN (SELECT doc_id FROM old WHERE status = 'deleted')""")
def story_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert that never revives a tombstone."""
    rows = stories(spark, sf_dir)
    old = rows.where("doc_id % 2 = 0").select("doc_id", "score", F.when(F.col("doc_id") % 7 == 0, "deleted").otherwise("captured").alias("status"))
    new = rows.where("doc_id % 3 = 0").select("doc_id", (F.col("score") + 1).alias("score"), F.lit("captured").alias("status"))
    return history.upsert(old, new, "doc_id", F.col("status") == "deleted")


@query(SQL + """SELECT channel, count(*) AS n, count(*) FILTER (score >= 65) AS strong, round(avg(score), 6) AS mean_score, max(captured)::VARCHAR AS last FROM stories GROUP BY channel""")
def channel_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    strong = F.count_if(F.col("score") >= 65)
    last = F.date_format(F.max("captured"), "yyyy-MM-dd HH:mm:ss")
    return stories(spark, sf_dir).groupBy("channel").agg(F.count("*").alias("n"), strong.alias("strong"), F.round(F.avg("score"), 6).alias("mean_score"), last.alias("last"))


@query(SQL + """SELECT source, n FROM (SELECT source, count(*) AS n FROM stories GROUP BY source) ORDER BY n DESC, source LIMIT 15""")
def top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen sources with most stories (a report, cut by design)."""
    return stories(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(15)


@query(SQL + """SELECT doc_id, 50 + least(greatest(score - 40, 0), 30) + CASE WHEN channel = 'en' THEN 100 ELSE 0 END - CASE WHEN n_chars < 500 THEN 10 ELSE 0 END AS priority FROM stories""")
def source_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = 50 + classify.clamp(F.col("score") - 40, 0, 30) + F.when(F.col("channel") == "en", 100).otherwise(0) - F.when(F.col("n_chars") < 500, 10).otherwise(0)
    return stories(spark, sf_dir).select("doc_id", value.alias("priority"))
