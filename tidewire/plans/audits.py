"""Metrics, error memory, cooldowns and models over the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import anomaly, severity, state
from tidewire.plans.registry import query
from tidewire.plans.stories import NOW
from tidewire.session import read_table


@query(f"""SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean_value, round(sum(value), 2) AS total, round(count(*) FILTER (value > 50) / greatest(1, count(*)), 6) AS rate
FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '{NOW}' GROUP BY event_type""")
def metrics_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, means and sums of the last day; a ratio guarded against no rows."""
    rows = read_table(spark, sf_dir, "events").where(f"ts >= timestamp_ntz'{NOW}' - interval 24 hours and ts <= timestamp_ntz'{NOW}'")
    rate = F.count_if(F.col("value") > 50) / F.greatest(F.lit(1), F.count("*"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean_value"), F.round(F.sum("value"), 2).alias("total"), F.round(rate, 6).alias("rate"))


@query(f"""SELECT count(*) FILTER (ts::DATE = DATE '2024-01-29') AS that_day, count(*) FILTER (ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS week, count(*) AS total, count(DISTINCT user_id) AS sources FROM events""")
def captured_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one day, of a week and in all."""
    day, week = F.count_if(F.to_date("ts") == F.lit("2024-01-29").cast("date")), F.count_if(F.expr(f"ts >= timestamp_ntz'{NOW}' - interval 7 days"))
    return read_table(spark, sf_dir, "events").agg(day.alias("that_day"), week.alias("week"), F.count("*").alias("total"), F.count_distinct("user_id").alias("sources"))


@query("""SELECT substr(event_type || ' ' || props, 1, 180) AS key, count(*) AS n, min(ts)::VARCHAR AS first, max(ts)::VARCHAR AS last, max(struct_pack(ts := ts, event_id := event_id)).event_id AS last_event
FROM events WHERE event_type IN ('error', 'click') GROUP BY 1""".replace("min(ts)::VARCHAR", "strftime(min(ts), '%Y-%m-%d %H:%M:%S')").replace("max(ts)::VARCHAR", "strftime(max(ts), '%Y-%m-%d %H:%M:%S')"))
def known_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error memory by text: how often, first and last time, last row."""
    rows = read_table(spark, sf_dir, "events").where("event_type in ('error', 'click')")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    key = F.substring(F.concat("event_type", F.lit(" "), "props"), 1, 180)
    last = F.max(F.struct("ts", "event_id"))["event_id"]
    return rows.groupBy(key.alias("key")).agg(F.count("*").alias("n"), stamp(F.min("ts")).alias("first"), stamp(F.max("ts")).alias("last"), last.alias("last_event"))


@query("""SELECT event_id, user_id, (props::JSON ->> 'k')::INT AS k FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 200""")
def latest_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 latest publications with their JSON read (a report, cut by design)."""
    rows = read_table(spark, sf_dir, "events").where("event_type = 'purchase'").orderBy(F.desc("ts"), F.desc("event_id")).limit(200)
    return rows.select("event_id", "user_id", F.from_json("props", "k int")["k"].alias("k"))


@query("""WITH a AS (SELECT DISTINCT ts::DATE AS d FROM events WHERE event_type = 'error'), b AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders),
k AS (SELECT d, 'both' AS side FROM (SELECT d FROM a INTERSECT SELECT d FROM b) UNION ALL SELECT d, 'events' FROM (SELECT d FROM a EXCEPT SELECT d FROM b)) SELECT strftime(d, '%Y-%m-%d') AS day, side FROM k""")
def day_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with errors, split by whether orders have them too."""
    a = read_table(spark, sf_dir, "events").where("event_type = 'error'").select(F.to_date("ts").alias("d"))
    b = read_table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d"))
    sides = a.intersect(b).withColumn("side", F.lit("both")).union(a.subtract(b).withColumn("side", F.lit("events")))
    return sides.select(F.date_format("d", "yyyy-MM-dd").alias("day"), "side")


@query("""WITH l AS (SELECT *, max(ts) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM events)
SELECT event_id, user_id, coalesce(ts < last + INTERVAL 6 HOUR, false) AS waits FROM l""")
def source_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that come within six hours of an earlier error of their source."""
    rows = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return state.cooling(rows, "user_id", "ts", ["event_id"], F.col("event_type") == "error", 6 * 3600).select("event_id", "user_id", "waits")


@query("""SELECT tag, count(*) AS n FROM (SELECT unnest(CASE WHEN len(t) = 0 THEN ['other'] ELSE t END) AS tag FROM (SELECT list_filter([CASE WHEN event_type = 'error' THEN 'failure' END, CASE WHEN value > 60 THEN 'slow' END, CASE WHEN contains(props, '"k": 4') THEN 'blocked' END, CASE WHEN contains(props, '9') THEN 'parse' END], lambda x: x IS NOT NULL) AS t FROM events)) GROUP BY tag""")
def failure_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by tag; a row can have several, and has ``other`` when it has none."""
    tags = F.array_compact(F.array(F.when(F.col("event_type") == "error", "failure"), F.when(F.col("value") > 60, "slow"), F.when(F.contains("props", F.lit('"k": 4')), "blocked"), F.when(F.contains("props", F.lit("9")), "parse")))
    rows = read_table(spark, sf_dir, "events").select(F.explode(F.when(F.size(tags) == 0, F.array(F.lit("other"))).otherwise(tags)).alias("tag"))
    return rows.groupBy("tag").agg(F.count("*").alias("n"))


@query()
def adaptive_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waiting time of each source after each cycle; a fold that SQL windows cannot write, tested against plain Python."""
    rows = read_table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return state.adaptive_intervals(rows, "user_id", ["ts", "event_id"], F.col("value") > 20).select("user_id", "event_id", "seconds")


@query()
def cycle_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isolation scores of hourly cycles; random trees, tested on planted outliers."""
    errors, made = F.count_if(F.col("event_type") == "error"), F.count_if(F.col("event_type") == "purchase")
    hours = read_table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("hour")).agg(F.count("*").alias("n"), made.alias("made"), errors.alias("errors"), F.avg("value").alias("mean_value"))
    return anomaly.anomalies(hours, "hour", ["n", "made", "errors", "mean_value"])


@query()
def text_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity class of every text from a network fitted to the labels; tested on held-out labels."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    severe = (2 * (1 - F.col("quality")) + F.col("toxic")).cast("double")
    return severity.predict(severity.fit(docs.join(labels, "doc_id").select("doc_id", "text", severe.alias("label")), "text", "label", 4, "doc_id"), docs, "doc_id", "text")
