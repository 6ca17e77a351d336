"""Rollups, state folds and vector search over logs, conversations, star tables and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.operators import classify, draws, history, state, vectors
from tidewire.plans.registry import query
from tidewire.session import read_table


@query("""SELECT event_type, count(*) AS n FROM events GROUP BY event_type""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT strftime(ts, '%Y-%m-%d %H') AS hour, count(*) AS sources, count(*) FILTER (event_type = 'purchase') AS made, count(*) FILTER (event_type = 'error') AS errors,
  round(avg(value), 6) AS mean_value, round(count(*) FILTER (event_type = 'purchase') / greatest(count(*), 1), 6) AS rate, 1800 AS seconds FROM events GROUP BY 1""")
def hourly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly cycles; hours without rows are absent."""
    made, errors, n = F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type") == "error"), F.count("*")
    return (
        read_table(spark, sf_dir, "events")
        .groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("hour"))
        .agg(n.alias("sources"), made.alias("made"), errors.alias("errors"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(made / F.greatest(n, F.lit(1)), 6).alias("rate"))
        .withColumn("seconds", F.lit(1800))
    )


@query("""SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean_value, count(*) FILTER (event_type = 'error') AS errors, max(ts)::VARCHAR AS last,
  round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_rate FROM events WHERE user_id IS NOT NULL GROUP BY user_id""")
def source_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = F.count_if(F.col("event_type") == "error")
    rows = read_table(spark, sf_dir, "events").where("user_id is not null").groupBy("user_id")
    last = F.regexp_replace(F.max("ts").cast("string"), "T", " ")
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), errors.alias("errors"), last.alias("last"), F.round(errors / F.count("*"), 6).alias("error_rate"))


@query("""WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, avg(value) AS m FROM events GROUP BY 1), w AS (SELECT *, lag(n) OVER (ORDER BY day) AS before FROM d)
SELECT day, n, before, CASE WHEN before IS NULL THEN NULL WHEN before = 0 THEN n * 100.0 ELSE round((n - before) * 100.0 / before, 2) END AS delta FROM w""")
def metric_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per cent change of each day's count; the days are few whatever the number of events."""
    days = read_table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    rows = days.withColumn("before", F.lag("n").over(Window.orderBy("day")))
    return rows.withColumn("delta", F.when(F.col("before") == 0, F.col("n") * 100.0).otherwise(F.round((F.col("n") - F.col("before")) * 100.0 / F.col("before"), 2)))


@query("""WITH f AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type IN ('error', 'click') GROUP BY ALL)
SELECT user_id, sum(n)::BIGINT AS failures, sum(n) FILTER (event_type = 'error')::BIGINT AS errors FROM f GROUP BY user_id ORDER BY failures DESC, user_id LIMIT 50""")
def failure_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty sources with most failures (a report, cut by design)."""
    rows = read_table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "click")).groupBy("user_id")
    errors = F.sum(F.when(F.col("event_type") == "error", 1))
    return rows.agg(F.count("*").alias("failures"), errors.alias("errors")).orderBy(F.desc("failures"), "user_id").limit(50)


@query("""WITH e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n_so_far FROM events WHERE event_type = 'error')
SELECT event_id, user_id, n_so_far, n_so_far >= 3 AS blocked FROM e""")
def recurrence_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "user_id", "ts")
    return state.recurrences(rows, "user_id", ["ts", "event_id"]).select("event_id", "user_id", F.col("n_so_far").cast("long").alias("n_so_far"), "blocked")


@query("""WITH f AS (SELECT *, (event_type IN ('error', 'view'))::INT AS f FROM events), r AS (SELECT *, sum(1 - f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM f),
s AS (SELECT event_id, user_id, sum(f) OVER (PARTITION BY user_id, run ORDER BY ts, event_id)::BIGINT AS streak FROM r) SELECT *, streak >= 5 AS quarantined FROM s""")
def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive failures since the last success, and quarantine at five."""
    rows = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return state.failure_streaks(rows, "user_id", ["ts", "event_id"], F.col("event_type").isin("error", "view")).select("event_id", "user_id", "streak", "quarantined")


@query()
def adaptive_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold of each source after each event; a fold that SQL windows cannot write, tested against plain Python."""
    rows = read_table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return state.adaptive_thresholds(rows, "user_id", ["ts", "event_id"], F.col("value") > 40).select("user_id", "event_id", "threshold")


@query("""SELECT event_type, user_id % 10 AS slot, count(*) AS recurrence, arg_max(event_id, (ts, event_id)) AS last_event, round(arg_max(value, (ts, event_id)), 6) AS last_value FROM events GROUP BY 1, 2""")
def counting_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recurrence counter with the last writer's fields."""
    rows = read_table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 10).alias("slot"), "ts", F.col("event_id").alias("last_event"), F.round("value", 6).alias("last_value"))
    return history.counting_upsert(rows, ["event_type", "slot"], F.struct("ts", "last_event"), ["last_event", "last_value"])


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE event_type <> 'view') SELECT user_id, event_type AS reason, event_id FROM o WHERE r = 1""")
def first_block_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason that blocked a source stays."""
    rows = read_table(spark, sf_dir, "events").where("event_type <> 'view'").groupBy("user_id")
    return rows.agg(F.min(F.struct("ts", "event_id", "event_type")).alias("first")).select("user_id", F.col("first.event_type").alias("reason"), "first.event_id")


@query("""SELECT conv_id, max(turn) + 1 AS next_version, count(*) AS versions FROM conversations GROUP BY conv_id""")
def next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.max("turn") + 1).alias("next_version"), F.count("*").alias("versions"))


@query("""SELECT event_id, user_id, greatest(0, 3 - (SELECT count(*) FROM events p WHERE p.user_id = e.user_id AND p.ts > e.ts - INTERVAL 1 HOUR AND p.ts <= e.ts)) AS slots FROM events e WHERE user_id IS NOT NULL""")
def hourly_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publications a source has left in the hour before each event, its lower bound outside."""
    micros = F.expr("unix_micros(cast(ts as timestamp))")
    w = Window.partitionBy("user_id").orderBy("at").rangeBetween(-3_600_000_000 + 1, 0)
    rows = read_table(spark, sf_dir, "events").where("user_id is not null").withColumn("at", micros)
    return rows.select("event_id", "user_id", F.greatest(F.lit(0), 3 - F.count("*").over(w)).alias("slots"))


@query("""SELECT user_id, 1 + count(*) FILTER (event_type = 'purchase') AS alpha, 1 + count(*) FILTER (event_type = 'error') AS beta,
  round((1 + count(*) FILTER (event_type = 'purchase')) / (2 + count(*) FILTER (event_type IN ('purchase', 'error'))), 6) AS mean FROM events GROUP BY user_id""")
def bandit_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beta posterior of each source from a prior of (1, 1)."""
    alpha, beta = 1 + F.count_if(F.col("event_type") == "purchase"), 1 + F.count_if(F.col("event_type") == "error")
    return read_table(spark, sf_dir, "events").groupBy("user_id").agg(alpha.alias("alpha"), beta.alias("beta"), F.round(alpha / (alpha + beta), 6).alias("mean"))


@query("""WITH l AS (SELECT user_id, event_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
g AS (SELECT *, sum((before IS DISTINCT FROM event_type)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS lot FROM l)
SELECT user_id, lot::BIGINT AS lot, event_type, count(*) AS n FROM g GROUP BY ALL""")
def collection_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one label as sessions."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = read_table(spark, sf_dir, "events").withColumn("new", (~F.lag("event_type").over(w).eqNullSafe(F.col("event_type"))).cast("int"))
    return rows.withColumn("lot", F.sum("new").over(w)).groupBy("user_id", "lot", "event_type").agg(F.count("*").alias("n"))


_COUNTS = ", ".join(f"len(list_filter([{', '.join(repr(t) for t in terms)}], lambda t: contains(line, t))) AS {name}" for name, terms in classify.AGENTS.items())
_TOP = f"greatest({', '.join(classify.AGENTS)})"


@query(f"""WITH l AS (SELECT event_id, lower(event_type || ' ' || props || CASE WHEN event_id % 3 = 0 THEN ' rss 429' WHEN event_id % 5 = 0 THEN ' imagem fila' ELSE '' END) AS line FROM events), c AS (SELECT event_id, {_COUNTS} FROM l)
SELECT agent, count(*) AS n FROM (SELECT CASE WHEN {_TOP} = 0 THEN 'regressao' {' '.join(f"WHEN {n} = {_TOP} THEN '{n}'" for n in classify.AGENTS)} END AS agent FROM c) GROUP BY agent""")
def log_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines by the agent whose patterns they hold most of, the first on ties."""
    extra = F.when(F.col("event_id") % 3 == 0, " rss 429").when(F.col("event_id") % 5 == 0, " imagem fila").otherwise("")
    line = F.lower(F.concat("event_type", F.lit(" "), "props", extra))
    rows = read_table(spark, sf_dir, "events").select(classify.by_dictionary(line, classify.AGENTS, "regressao")["name"].alias("agent"))
    return rows.groupBy("agent").agg(F.count("*").alias("n"))


@query("""SELECT event_id, (props::JSON ->> 'k')::INT AS k, CASE WHEN (props::JSON ->> 'k')::INT <= 0 THEN 65 ELSE (props::JSON ->> 'k')::INT END AS score FROM events""")
def json_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON fields over columns; scores of 0 and less become 65."""
    k = F.from_json("props", "k int")["k"]
    return read_table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.when(k <= 0, 65).otherwise(k).alias("score"))


@query("""WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0), a AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.vec_id AS query, a.vec_id AS id, round(list_cosine_similarity(q.v, a.v), 6) AS similarity FROM q JOIN a ON q.vec_id <> a.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id)::INT AS rank FROM s) SELECT query, id, similarity, rank FROM r WHERE rank <= 5""")
def cosine_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50."""
    rows = read_table(spark, sf_dir, "embeddings")
    return vectors.cosine_top_k(rows, rows.where("vec_id % 50 = 0"), "vec_id", "embedding", 5)


@query("""SELECT n_name, r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def star_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by nation; nation and region have 25 and 5 rows."""
    t = lambda name: read_table(spark, sf_dir, name)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.groupBy("c_nationkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.count("*").alias("n"))
    rows = rows.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("n_name", "r_name", F.round("revenue", 2).alias("revenue"), "n")


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return rows.agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count("*").alias("n"))


def _gamma_sql(shape: str, seed: str) -> str:
    u = lambda j: f"((('0x' || substr(md5({seed} || '|' || i || '|{j}'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"
    x, d = f"(sqrt(-2 * ln({u(0)})) * cos(2 * pi() * {u(1)}))", f"({shape} - 1.0 / 3)"
    v = f"pow(1 + {x} / sqrt(9 * {d}), 3.0)"
    return f"list_filter(list_transform(range(16), lambda i: CASE WHEN {v} > 0 AND ln({u(2)}) < 0.5 * {x} * {x} + {d} - {d} * {v} + {d} * ln(greatest({v}, 1e-300)) THEN {d} * {v} END), lambda v: v IS NOT NULL)[1]"


@query(f"""WITH a AS (SELECT user_id, 1.0::DOUBLE + count(*) FILTER (event_type = 'purchase') AS alpha, 1.0::DOUBLE + count(*) FILTER (event_type = 'error') AS beta FROM events GROUP BY user_id),
c AS (SELECT DISTINCT ts::DATE AS day, user_id FROM events), s AS (SELECT day, user_id, alpha, beta, '0|' || day::VARCHAR || '|' || user_id AS seed FROM c JOIN a USING (user_id)),
g AS (SELECT day, user_id, {_gamma_sql("alpha", "seed || '|a'")} AS x, {_gamma_sql("beta", "seed || '|b'")} AS y FROM s)
SELECT day, user_id, round(x / (x + y), 6) AS draw FROM g QUALIFY row_number() OVER (PARTITION BY day ORDER BY x / (x + y) DESC, user_id) = 1""")
def bandit_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source that wins each day among those with events: the greatest beta draw of their successes and failures, the same on every replay."""
    events = read_table(spark, sf_dir, "events")
    count = lambda kind: (F.lit(1.0) + F.count_if(F.col("event_type") == kind)).alias("alpha" if kind == "purchase" else "beta")
    arms = events.groupBy("user_id").agg(count("purchase"), count("error"))
    made = draws.bandit_draws(arms, events.select(F.to_date("ts").alias("day"), "user_id"), "user_id", "day")
    return draws.winners(made, "user_id", "day").select("day", "user_id", F.round("draw", 6).alias("draw"))
