"""Gates, queue filters, ordered lists and state changes over stories and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.functions import urls
from tidewire.functions.text import fold, tokens
from tidewire.operators import gates
from tidewire.operators.classify import clamp, rounded_means
from tidewire.operators.ranking import global_rank
from tidewire.plans.registry import query
from tidewire.plans.stories import FOLD, LINK_KEY, NOW, SQL, TOKENS, stories
from tidewire.session import read_table

#: Stories with a status, an extraction method and text lengths, as a collector leaves them.
STATES = ("new", "published", "deleted", "rejected", "blocked", "short_usable", "failed")
METHODS = ("scraped", "rss_only", "unresolved", "failed", "source_too_short", "snippet_rss")
LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
EXTRACTED = SQL + f""", x AS (SELECT *, {LIST(STATES)}[(doc_id * 7 % 7 + doc_id // 11 % 7) % 7 + 1] AS status, {LIST(METHODS)}[doc_id // 3 % 6 + 1] AS method, n_chars * 2 // 3 AS useful FROM stories)
"""


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda xs, at: F.element_at(F.array(*map(F.lit, xs)), (at + 1).cast("int"))
    ident = F.col("doc_id")
    status = pick(STATES, (ident * 7 % 7 + F.floor(ident / 11) % 7) % 7)
    return stories(spark, sf_dir).withColumns({"status": status, "method": pick(METHODS, F.floor(ident / 3) % 6), "useful": F.floor(F.col("n_chars") * 2 / 3)})


@query(EXTRACTED + """SELECT doc_id, method, CASE WHEN status = 'failed' THEN 'extraction_failed' WHEN method IN ('failed', 'source_too_short') THEN 'invalid_method' WHEN method = 'unresolved' THEN 'unresolved'
  WHEN method = 'rss_only' THEN 'rss_only' WHEN method NOT IN ('scraped') THEN 'no_real_url' WHEN status = 'short_usable' THEN 'short_usable' WHEN useful < 500 THEN 'too_little_text' WHEN n_chars < 500 THEN 'too_little_scraped' ELSE 'ok' END AS extraction,
  CASE WHEN status = 'failed' THEN 'extraction_failed' WHEN method IN ('failed', 'source_too_short') THEN 'invalid_method' WHEN method = 'unresolved' THEN 'unresolved'
  WHEN method = 'rss_only' THEN 'rss_only' WHEN status = 'short_usable' THEN 'short_usable' WHEN useful < 500 THEN 'too_little_text' ELSE 'ok' END AS capture,
  contains(method, 'rss') OR contains(method, 'snippet') AS snippet FROM x""")
def extraction_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fail-closed verdicts on an extraction and on a capture, and whether its method is a snippet's."""
    c = F.col
    return extracted(spark, sf_dir).select(
        "doc_id", "method",
        gates.extraction_gate(c("status"), c("method"), c("useful"), c("n_chars"), c("method") == "scraped").alias("extraction"),
        gates.capture_gate(c("status"), c("method"), c("useful")).alias("capture"),
        gates.any_term(c("method"), ("rss", "snippet")).alias("snippet"),
    )


@query("""WITH r AS (SELECT doc_id, doc_id % 50 AS k, CASE WHEN doc_id % 50 IN (5, 13) THEN NULL WHEN doc_id % 50 = 7 THEN repeat(chr(10), 200) || left(text, 100) ELSE text END AS text FROM documents)
SELECT doc_id, CASE WHEN k = 11 THEN 'invalid' WHEN k IN (3, 13) THEN 'http_403' WHEN k = 29 THEN 'http_429' WHEN length(regexp_replace(coalesce(text, ''), '\\A\\s+|\\s+\\z', '', 'g')) < 120 THEN 'short' ELSE 'ok' END AS verdict, length(text) AS size FROM r""".replace("\\\\", "\\"))
def source_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on each fetched source: some have no result, are refused with a text or without one, or are white space and a short text."""
    k = F.col("doc_id") % 50
    status = F.when(k.isin(3, 13), 403).when(k == 29, 429).otherwise(200)
    text = F.when(k.isin(5, 13), None).when(k == 7, F.concat(F.repeat(F.lit("\n"), 200), F.substring("text", 1, 100))).otherwise(F.col("text"))
    rows = read_table(spark, sf_dir, "documents").select("doc_id", k.alias("k"), status.alias("status"), text.alias("text"))
    return rows.select("doc_id", gates.source_contract(F.col("status"), F.col("text"), present=F.col("k") != 11).alias("verdict"), F.length("text").alias("size"))


@query(SQL + f""", o AS (SELECT doc_id, title, lead(title) OVER (PARTITION BY source ORDER BY doc_id) AS other FROM stories),
j AS (SELECT doc_id, text, {TOKENS.format('title')} AS w, {TOKENS.format('other')} AS v, {TOKENS.format('text')} AS t FROM o JOIN documents USING (doc_id)),
k AS (SELECT doc_id, length(text) < 120 AS short, len(w) > 0 AND len(list_intersect(w, t)) < CASE WHEN len(w) <= 2 THEN 1 ELSE 2 END AS a, len(v) > 0 AND len(list_intersect(v, t)) < CASE WHEN len(v) <= 2 THEN 1 ELSE 2 END AS b FROM j)
SELECT doc_id, CASE WHEN short THEN 'short' WHEN a THEN 'other_subject' ELSE 'ok' END AS own, CASE WHEN short THEN 'short' WHEN b THEN 'other_subject' ELSE 'ok' END AS swapped FROM k""")
def text_belongs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text is about its title, and about the next title of its source (as in a contaminated row)."""
    other = F.lead("title").over(Window.partitionBy("source").orderBy("doc_id"))
    own = stories(spark, sf_dir).select("doc_id", "title", other.alias("other"))
    joined = own.join(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return joined.select("doc_id", gates.belongs(F.col("title"), F.col("text")).alias("own"), gates.belongs(F.col("other"), F.col("text")).alias("swapped"))


@query(EXTRACTED + f"""SELECT doc_id, status, score < 40 AS low FROM x WHERE status NOT IN ('deleted', 'rejected', 'blocked') AND contains({FOLD.format("coalesce(title, '') || ' ' || coalesce(source, '') || ' ' || coalesce(channel, '')")}, 'en')""")
def status_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows on view: hidden statuses out, an accent-folded substring over several fields, low scores marked for the end."""
    said = fold(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("source", F.lit("")), F.coalesce("channel", F.lit(""))))
    rows = extracted(spark, sf_dir).where(~F.col("status").isin("deleted", "rejected", "blocked") & F.contains(said, F.lit("en")))
    return rows.select("doc_id", "status", (F.col("score") < 40).alias("low"))


@query(EXTRACTED + """SELECT doc_id, status FROM x WHERE status NOT IN ('published', 'deleted', 'blocked') AND link <> '' ORDER BY captured DESC, doc_id LIMIT 100""")
def auto_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 latest rows that may be written up (a queue, cut by design)."""
    rows = extracted(spark, sf_dir).where(~F.col("status").isin("published", "deleted", "blocked") & (F.col("link") != ""))
    return rows.orderBy(F.desc("captured"), "doc_id").limit(100).select("doc_id", "status")


@query(EXTRACTED + """SELECT doc_id, doc_id % 13 = 0 OR status = 'blocked' OR status <> 'new' OR method IN ('rss_only', 'failed') AS review,
  array_to_string(list_filter([CASE WHEN title IS NULL OR trim(title) = '' THEN 'no_title' END, CASE WHEN n_chars < 120 THEN 'short_body' END, CASE WHEN source IS NULL THEN 'no_source' END, CASE WHEN status IN ('failed', 'blocked') THEN 'fatal_status' END,
  CASE WHEN method IN ('failed', 'source_too_short') THEN 'bad_method' END, CASE WHEN useful < 350 THEN 'little_source' END, CASE WHEN score >= 70 THEN 'risk' END], lambda r: r IS NOT NULL), ',') AS fatal FROM x""")
def review_and_fatal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a person must look at a row, and all fatal reasons against it."""
    c = F.col
    review = (c("doc_id") % 13 == 0) | (c("status") == "blocked") | (c("status") != "new") | c("method").isin("rss_only", "failed")
    fatal = gates.reasons(
        (c("title").isNull() | (F.trim("title") == ""), "no_title"), (c("n_chars") < 120, "short_body"), (c("source").isNull(), "no_source"), (c("status").isin("failed", "blocked"), "fatal_status"),
        (c("method").isin("failed", "source_too_short"), "bad_method"), (c("useful") < 350, "little_source"), (c("score") >= 70, "risk"),
    )
    return extracted(spark, sf_dir).select("doc_id", review.alias("review"), F.array_join(fatal, ",").alias("fatal"))


@query(EXTRACTED + """SELECT doc_id, CASE WHEN status IN ('blocked', 'deleted') THEN 'gate' ELSE array_to_string(list_filter([CASE WHEN useful < 900 THEN 'coverage' END, CASE WHEN score < 60 THEN 'quality' END, CASE WHEN score % 10 > 6 THEN 'risk' END], lambda r: r IS NOT NULL), ',') END AS reasons FROM x""")
def publish_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a row is not published by itself: the gate alone where it fails, else all of coverage, quality and risk."""
    c = F.col
    rest = gates.reasons((c("useful") < 900, "coverage"), (c("score") < 60, "quality"), (c("score") % 10 > 6, "risk"))
    return extracted(spark, sf_dir).select("doc_id", F.when(c("status").isin("blocked", "deleted"), "gate").otherwise(F.array_join(rest, ",")).alias("reasons"))


@query(SQL + """, p(host, pause, tries) AS (VALUES ('*', 30, 1), ('src1.example.com', 60, 2), ('src2.example.com', 600, 3)),
s AS (SELECT doc_id, regexp_replace(lower(regexp_extract(link, '://([^/?#]*)', 1)), '^www\\.', '') AS host FROM stories)
SELECT doc_id, coalesce(p.pause, d.pause) AS pause, coalesce(p.tries, d.tries) AS tries FROM s LEFT JOIN p ON p.host = s.host JOIN p d ON d.host = '*'""".replace("\\\\", "\\"))
def domain_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policy of a row's domain, or the default one."""
    policy = spark.createDataFrame([("src1.example.com", 60, 2), ("src2.example.com", 600, 3)], "host string, pause int, tries int")
    rows = stories(spark, sf_dir).select("doc_id", urls.host(F.col("link")).alias("host"))
    return rows.join(policy, "host", "left").select("doc_id", F.coalesce("pause", F.lit(30)).alias("pause"), F.coalesce("tries", F.lit(1)).alias("tries"))


@query(EXTRACTED + f"""SELECT a.doc_id, EXISTS (SELECT 1 FROM x p WHERE p.status = 'published' AND p.link = a.link AND p.doc_id <> a.doc_id AND p.captured >= TIMESTAMP '{NOW}' - INTERVAL 12 DAY) AS known FROM x a""")
def published_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether another row with the same link was published in the last twelve days."""
    rows = extracted(spark, sf_dir)
    recent = rows.where((F.col("status") == "published") & F.expr(f"captured >= timestamp_ntz'{NOW}' - interval 12 days"))
    by_link = recent.groupBy("link").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    return rows.join(by_link, "link", "left").select("doc_id", F.coalesce((F.col("low") != F.col("doc_id")) | (F.col("high") != F.col("doc_id")), F.lit(False)).alias("known"))


@query(SQL + """, o AS (SELECT source AS domain, doc_id, title, channel, score FROM stories), old AS (SELECT domain, arg_min(title, doc_id) AS title, arg_min(channel, doc_id) AS channel FROM o WHERE doc_id % 2 = 0 GROUP BY domain),
new AS (SELECT domain, arg_max(nullif(title, ''), doc_id) AS title, arg_max(CASE WHEN score > 50 THEN channel END, doc_id) AS channel FROM o WHERE doc_id % 2 = 1 GROUP BY domain)
SELECT domain, coalesce(new.title, old.title) AS title, coalesce(new.channel, old.channel) AS channel FROM old FULL JOIN new USING (domain)""")
def domain_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of new rows that are not empty override the row of their domain; new domains are added."""
    rows = stories(spark, sf_dir).withColumnRenamed("source", "domain")
    old = rows.where("doc_id % 2 = 0").groupBy("domain").agg(F.min_by("title", "doc_id").alias("title"), F.min_by("channel", "doc_id").alias("channel"))
    filled = rows.where("doc_id % 2 = 1")
    said = F.when(F.col("title") != "", F.col("title"))
    strong = F.when(F.col("score") > 50, F.col("channel"))
    last = lambda v: F.max_by(v, F.when(v.isNotNull(), F.col("doc_id")))
    new = filled.groupBy("domain").agg(last(said).alias("new_title"), last(strong).alias("new_channel"))
    return old.join(new, "domain", "full").select("domain", F.coalesce("new_title", "title").alias("title"), F.coalesce("new_channel", "channel").alias("channel"))


@query("""WITH e AS (SELECT *, CASE event_type WHEN 'purchase' THEN 3 WHEN 'error' THEN -4 ELSE 1 END AS delta FROM events),
u AS (SELECT user_id, sum(delta)::BIGINT AS w FROM e GROUP BY 1), t AS (SELECT event_type, sum(delta)::BIGINT AS w FROM e GROUP BY 1)
SELECT event_id, greatest(-20, least(25, greatest(-10, least(12, floor(u.w / 3.0))) + greatest(-8, least(8, floor(t.w / 4.0)))))::BIGINT AS bonus FROM events JOIN u USING (user_id) JOIN t USING (event_type)""")
def memory_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights that decisions left on sources and channels, and the clamped bonus of every row."""
    rows = read_table(spark, sf_dir, "events")
    delta = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "error", -4).otherwise(1)
    weigh = lambda key, name: rows.groupBy(key).agg(F.sum(delta).alias(name))
    joined = rows.join(weigh("user_id", "by_user"), "user_id").join(weigh("event_type", "by_type"), "event_type")
    total = clamp(F.floor(F.col("by_user") / 3), -10, 12) + clamp(F.floor(F.col("by_type") / 4), -8, 8)
    return joined.select("event_id", clamp(total, -20, 25).cast("long").alias("bonus"))


@query(SQL + f""", w AS (SELECT score, unnest(list_filter({TOKENS.format('title')}, lambda w: length(w) >= 4)[1:12]) AS term FROM stories)
SELECT term, sum(CASE WHEN score >= 70 THEN 4 WHEN score < 20 THEN -3 ELSE 1 END)::BIGINT AS weight, count(*) AS n FROM w GROUP BY term""")
def decision_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each decision adds to the first twelve longer words of its title, summed by word."""
    words = F.slice(F.filter(tokens(F.col("title")), lambda w: F.length(w) >= 4), 1, 12)
    rows = stories(spark, sf_dir).select("score", F.explode(words).alias("term"))
    delta = F.when(F.col("score") >= 70, 4).when(F.col("score") < 20, -3).otherwise(1)
    return rows.groupBy("term").agg(F.sum(delta).alias("weight"), F.count("*").alias("n"))


@query(SQL + """SELECT doc_id, count(*) OVER (PARTITION BY source) AS context, score - least(30, 2 * (count(*) OVER (PARTITION BY source) - 1))::INT AS adjusted FROM stories""")
def source_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many candidates a row's source has, and the score less a penalty for it; counted by partial sums, so a hot source is no single task."""
    rows = stories(spark, sf_dir)
    joined = rows.join(rows.groupBy("source").agg(F.count("*").alias("context")), "source")
    return joined.select("doc_id", "context", (F.col("score") - F.least(F.lit(30), 2 * (F.col("context") - 1))).cast("int").alias("adjusted"))


@query("""WITH s AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad, round(avg(value), 2) AS priority FROM events GROUP BY user_id)
SELECT user_id, n, CASE WHEN bad * 5 > n THEN 'weak' ELSE 'good' END AS health, row_number() OVER (ORDER BY priority DESC, user_id) AS place FROM s WHERE n > 1 AND user_id % 9 <> 0""")
def source_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active sources that are not in quarantine, with their health, by priority."""
    rows = read_table(spark, sf_dir, "events").select("user_id", "event_type", "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("line")).where("user_id % 9 <> 0")
    own = rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("bad")).where("n > 1")
    kept = own.join(rounded_means(rows, "user_id", "value", 2, ["file", "line"]).withColumnRenamed("mean", "priority"), "user_id")
    placed = global_rank(kept, [F.desc("priority"), F.asc("user_id")], "place")
    return placed.select("user_id", "n", F.when(F.col("bad") * 5 > F.col("n"), "weak").otherwise("good").alias("health"), "place")


@query("""WITH f AS (SELECT DISTINCT regexp_extract(url, '^([^?#]*)', 1) AS url, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages),
c AS (SELECT url, host, CASE WHEN contains(url, '/feed') THEN 0 WHEN contains(url, '/rss') THEN 1 WHEN contains(url, 'sitemap') THEN 2 WHEN contains(url, '/en/') THEN 3 ELSE 9 END AS class FROM f)
SELECT url, class, row_number() OVER (PARTITION BY host ORDER BY class, length(url), url) AS place FROM c""")
def feed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct feed addresses of each site by class of path, length and address."""
    rows = read_table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^([^?#]*)", 1).alias("url"), F.regexp_extract("url", "://([^/?#]*)", 1).alias("host")).distinct()
    kind = F.lit(9)
    for k, part in reversed(list(enumerate(("/feed", "/rss", "sitemap", "/en/")))):
        kind = F.when(F.contains("url", F.lit(part)), k).otherwise(kind)
    place = F.row_number().over(Window.partitionBy("host").orderBy("class", F.length("url"), "url"))
    return rows.withColumn("class", kind).select("url", "class", place.alias("place"))


@query(SQL + """SELECT doc_id, CASE WHEN n_chars >= 550 THEN 5000 WHEN n_chars > 0 THEN 1000 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 1000 ELSE 0 END - CASE WHEN contains(lower(title), 'the') THEN 3000 ELSE 0 END - CASE WHEN starts_with(lower(title), 'a') THEN 8000 ELSE 0 END AS rank FROM stories""")
def visual_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of a row on the visual queue: text, image, and title patterns that push it down."""
    title = F.lower("title")
    worth = F.when(F.col("n_chars") >= 550, 5000).when(F.col("n_chars") > 0, 1000).otherwise(0) + F.when(F.col("doc_id") % 3 == 0, 1000).otherwise(0)
    less = F.when(F.contains(title, F.lit("the")), 3000).otherwise(0) + F.when(F.startswith(title, F.lit("a")), 8000).otherwise(0)
    return stories(spark, sf_dir).select("doc_id", (worth - less).alias("rank"))


@query("""SELECT kind, event_id, user_id, n FROM (
  SELECT 'recent' AS kind, event_id, user_id, NULL::BIGINT AS n FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 50)
  UNION ALL SELECT 'blocked', event_id, user_id, NULL FROM (SELECT * FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 50)
  UNION ALL SELECT 'entries', last, user_id, n FROM (SELECT user_id, max(event_id) AS last, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY user_id ORDER BY n DESC, last DESC LIMIT 50)
  UNION ALL SELECT 'weights', NULL, user_id, w FROM (SELECT user_id, sum(value)::BIGINT AS w FROM events GROUP BY user_id ORDER BY w DESC, user_id LIMIT 50))""")
def memory_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The editor's lists: recent and blocked log rows, entries by recurrence, sources by weight (reports of 50 rows)."""
    rows = read_table(spark, sf_dir, "events")
    none = F.lit(None).cast("long")
    latest = lambda df, kind: df.orderBy(F.desc("event_id")).limit(50).select(F.lit(kind).alias("kind"), "event_id", "user_id", none.alias("n"))
    entries = rows.where("event_type = 'click'").groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("event_id")).limit(50)
    weights = rows.groupBy("user_id").agg(F.expr("cast(round(sum(value)) as long)").alias("n")).orderBy(F.desc("n"), "user_id").limit(50)
    parts = [latest(rows, "recent"), latest(rows.where("event_type = 'error'"), "blocked"), entries.select(F.lit("entries"), "event_id", "user_id", "n"), weights.select(F.lit("weights"), none, "user_id", "n")]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


@query(EXTRACTED + f"""SELECT {LINK_KEY.format('link')} AS key, max_by(doc_id, (useful, score, -doc_id)) AS best, max(useful)::BIGINT AS useful, count(*) AS n FROM x GROUP BY 1""".replace("max_by(doc_id, (useful, score, -doc_id))", "arg_max(doc_id, struct_pack(a := useful, b := score, c := -doc_id))"))
def best_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extraction of a link with the most useful text, then the best score, then the first."""
    rows = extracted(spark, sf_dir).withColumn("key", urls.key(F.col("link")))
    best = F.max_by("doc_id", F.struct("useful", "score", -F.col("doc_id")))
    return rows.groupBy("key").agg(best.alias("best"), F.max("useful").alias("useful"), F.count("*").alias("n"))


@query(SQL + """SELECT source, CASE WHEN max(n_chars) >= 900 THEN substr(arg_max(title, struct_pack(a := n_chars, b := -doc_id)), 1, 60) END AS longest, coalesce(arg_min(link, struct_pack(a := CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END, b := -score, c := doc_id)) FILTER (score > 60), 'default') AS image FROM stories GROUP BY source""")
def best_of_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest text of each source if it is long enough, and the first of its ranked images or a default."""
    longest = F.substring(F.max_by("title", F.struct("n_chars", -F.col("doc_id"))), 1, 60)
    rank = F.when(F.col("score") > 60, F.struct(F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1), -F.col("score"), "doc_id"))
    own = stories(spark, sf_dir).groupBy("source").agg(F.when(F.max("n_chars") >= 900, longest).alias("longest"), F.coalesce(F.min_by("link", rank), F.lit("default")).alias("image"))
    return own


@query("""WITH s AS (SELECT user_id, 1 + count(*) FILTER (event_type = 'purchase') AS alpha, 1.0 + count(*) FILTER (event_type = 'error') + 2 * count(*) FILTER (value < 1) AS beta FROM events GROUP BY user_id)
SELECT user_id, alpha, beta::DOUBLE AS beta, round(alpha / (alpha + beta), 6)::DOUBLE AS mean FROM s""")
def bandit_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beta parameters of each source: successes, failures, and two for each penalty."""
    own = read_table(spark, sf_dir, "events").groupBy("user_id").agg(
        (1 + F.count_if(F.col("event_type") == "purchase")).alias("alpha"), (F.lit(1.0) + F.count_if(F.col("event_type") == "error") + 2 * F.count_if(F.col("value") < 1)).alias("beta")
    )
    return own.withColumn("mean", F.round(F.col("alpha") / (F.col("alpha") + F.col("beta")), 6))


@query(EXTRACTED + f"""SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'deleted' WHEN status = 'deleted' AND doc_id % 5 = 0 THEN 'new' WHEN status = 'new' AND score > 90 THEN 'published' ELSE status END AS status,
  doc_id % 17 = 0 OR status = 'published' OR (status = 'deleted' AND doc_id % 5 <> 0) AS link_blocked,
  CASE WHEN doc_id % 17 = 0 THEN 'delete' WHEN status = 'deleted' AND doc_id % 5 = 0 THEN 'reactivate' WHEN status = 'new' AND score > 90 THEN 'publish' END AS audit,
  CASE WHEN doc_id % 17 = 0 OR (status = 'deleted' AND doc_id % 5 = 0) OR (status = 'new' AND score > 90) THEN '{NOW}' ELSE strftime(captured, '%Y-%m-%d %H:%M:%S') END AS updated FROM x""")
def status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft deletes, reactivations and publications: new status, whether the link is blocked, the audit row's action and the time of the change."""
    c = F.col
    deleted, back, out = c("doc_id") % 17 == 0, (c("status") == "deleted") & (c("doc_id") % 5 == 0), (c("status") == "new") & (c("score") > 90)
    return extracted(spark, sf_dir).select(
        "doc_id",
        F.when(deleted, "deleted").when(back, "new").when(out, "published").otherwise(c("status")).alias("status"),
        (deleted | (c("status") == "published") | ((c("status") == "deleted") & (c("doc_id") % 5 != 0))).alias("link_blocked"),
        F.when(deleted, "delete").when(back, "reactivate").when(out, "publish").alias("audit"),
        F.when(deleted | back | out, NOW).otherwise(F.date_format("captured", "yyyy-MM-dd HH:mm:ss")).alias("updated"),
    )


@query(SQL + """, t AS (SELECT doc_id, nullif(title, '') AS title, CASE WHEN doc_id % 4 <> 0 THEN channel END AS channel, doc_id % 10 = 7 AS dirty FROM stories)
SELECT doc_id, CASE WHEN dirty THEN '' ELSE coalesce(title, 'untitled') END AS title, coalesce(channel, 'general') AS channel, NULL::VARCHAR AS note, CASE WHEN dirty THEN 'new' ELSE 'kept' END AS status, channel IS NULL AS filled FROM t""")
def backfills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty fields set, a missing column added, contaminated rows blanked and sent back."""
    c = F.col
    rows = stories(spark, sf_dir).select("doc_id", F.when(c("title") != "", c("title")).alias("title"), F.when(c("doc_id") % 4 != 0, c("channel")).alias("channel"), (c("doc_id") % 10 == 7).alias("dirty"))
    return rows.select(
        "doc_id", F.when(c("dirty"), "").otherwise(F.coalesce("title", F.lit("untitled"))).alias("title"), F.coalesce("channel", F.lit("general")).alias("channel"),
        F.lit(None).cast("string").alias("note"), F.when(c("dirty"), "new").otherwise("kept").alias("status"), c("channel").isNull().alias("filled"),
    )


@query("""WITH j AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type, ts, event_id) AS place FROM events WHERE ts <= TIMESTAMP '2024-01-20' AND event_type <> 'error') SELECT user_id, event_id, event_type FROM j WHERE place = 1""")
def job_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next job of each worker: the first that is due, by priority and time."""
    due = read_table(spark, sf_dir, "events").where("ts <= timestamp_ntz'2024-01-20 00:00:00' and event_type <> 'error'")
    first = F.min(F.struct("event_type", "ts", "event_id"))
    return due.groupBy("user_id").agg(first.alias("job")).select("user_id", "job.event_id", "job.event_type")


@query(SQL + """, b AS (SELECT doc_id // 4 AS batch, doc_id, score, score >= 80 AS goes FROM stories), n AS (SELECT batch, bool_or(goes) AS any FROM b GROUP BY batch)
SELECT batch, doc_id FROM (SELECT b.batch, doc_id, row_number() OVER (PARTITION BY b.batch ORDER BY score DESC, doc_id) AS place FROM b JOIN n ON n.batch = b.batch AND NOT n.any) WHERE place <= 3""")
def low_score_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rows of each batch that gave nothing (the sample is the feature)."""
    rows = stories(spark, sf_dir).withColumn("batch", F.floor(F.col("doc_id") / 4))
    empty = rows.groupBy("batch").agg(F.max(F.col("score") >= 80).alias("any")).where("not any").select("batch")
    place = F.row_number().over(Window.partitionBy("batch").orderBy(F.desc("score"), "doc_id"))
    return rows.join(empty, "batch", "left_semi").withColumn("place", place).where("place <= 3").select("batch", "doc_id")
