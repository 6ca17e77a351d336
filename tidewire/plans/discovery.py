"""Feeds, sitemaps and article bodies: texts that Spark derives from stories and pages, parsed and scanned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.functions import text, urls
from tidewire.operators import scan
from tidewire.plans.registry import query
from tidewire.plans.stories import LINK_KEY, NOW, SQL, TOKENS, stories
from tidewire.session import read_table
from tidewire.sources import pages as html

CLEAN = "trim(regexp_replace(title, '[<>\\s]+', ' ', 'g'))"
ITEMS = SQL + f""", numbered AS (SELECT source || '-' || (doc_id // 50)::VARCHAR AS feed, doc_id, {CLEAN} AS title, link, CASE WHEN doc_id % 11 <> 0 THEN captured END AS seen FROM stories),
items AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY doc_id) - 1 AS place FROM numbered)"""


def feed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feed, xml): stories as texts of at most 50 entries; some are Atom entries, some have a guid for a link, some no date."""
    title = F.trim(F.regexp_replace("title", r"[<>\s]+", " "))
    at = F.when(F.col("doc_id") % 11 != 0, F.concat(F.lit("<pubDate>"), F.col("captured").cast("string"), F.lit("</pubDate>"))).otherwise("")
    link = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit('<link href="'), "link", F.lit('"/>')))
    link = link.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("<guid>"), "link", F.lit("</guid>"))).otherwise(F.concat(F.lit("<link>"), "link", F.lit("</link>")))
    tag = F.when(F.col("doc_id") % 5 == 0, "entry").otherwise("item")
    entry = F.concat(F.lit("<"), tag, F.lit("><title>"), title, F.lit("</title>"), link, at, F.lit("</"), tag, F.lit(">"))
    rows = stories(spark, sf_dir).select(F.concat_ws("-", "source", F.floor(F.col("doc_id") / 50).cast("string")).alias("feed"), "doc_id", entry.alias("entry"))
    made = rows.groupBy("feed").agg(F.array_sort(F.collect_list(F.struct("doc_id", "entry"))).alias("es"))
    return made.select("feed", F.array_join("es.entry", "\n").alias("xml"))


@query(ITEMS + f""", w AS (SELECT *, coalesce(seen BETWEEN TIMESTAMP '{NOW}' - INTERVAL 72 HOUR AND TIMESTAMP '{NOW}', false) AS inside FROM items WHERE title <> '' AND place < 30),
r AS (SELECT *, bool_or(inside) OVER (PARTITION BY feed) AS found, row_number() OVER (PARTITION BY feed, inside, seen IS NULL ORDER BY place) AS r FROM w)
SELECT feed, place::INT AS place, title, link, seen AS published, NOT found AS rescued FROM r WHERE (inside AND r <= 10) OR (NOT found AND seen IS NOT NULL AND r = 1)""")
def feed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run accepts of every feed: rows of the last 72 hours, ten a feed, else the first dated one."""
    items = html.feed_items(feed_texts(spark, sf_dir), "feed", "xml").withColumn("date", F.nullif("date", F.lit("")))
    kept = scan.scan_feeds(items, F.lit(NOW), 72)
    return kept.select("feed", "place", "title", "link", F.col("date").cast("timestamp_ntz").alias("published"), "rescued")


@query(ITEMS + """, y AS (SELECT feed, count(*) FILTER (doc_id % 5 <> 0 AND doc_id % 7 <> 0) AS strict, count(*) AS tolerant FROM items WHERE title <> '' GROUP BY feed)
SELECT feed, CASE WHEN strict >= tolerant THEN 'strict' ELSE 'tolerant' END AS parser, greatest(strict, tolerant) AS n FROM y""")
def parser_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parser of each feed: items with a link element, or items and entries with any kind of link; ties keep the strict one."""
    texts = feed_texts(spark, sf_dir)
    strict = texts.select("feed", F.explode(F.regexp_extract_all("xml", F.lit(r"(?is)<item>.*?</item>"), F.lit(0))).alias("e"))
    strict = strict.where(F.col("e").rlike("(?is)<title>[^<]+</title>.*<link>[^<]+</link>")).select("feed", F.lit("strict").alias("parser"), F.lit(0).alias("preferred"))
    tolerant = html.feed_items(texts, "feed", "xml").select("feed", F.lit("tolerant").alias("parser"), F.lit(1).alias("preferred"))
    return scan.best_parser(strict.unionByName(tolerant))


@query(rf"""WITH p AS (SELECT page_id, url, CASE WHEN page_id % 3 <> 0 THEN TIMESTAMP '2024-01-01' + to_minutes((page_id * 41) % 43200) END AS seen FROM pages),
f AS (SELECT * FROM p WHERE regexp_matches(url, '/(en|de|fr)/') AND NOT regexp_matches(lower(url), '[.](jpg|jpeg|png|gif|webp|svg|pdf|zip|mp4|mp3)') AND (seen IS NULL OR seen BETWEEN TIMESTAMP '{NOW}' - INTERVAL 240 HOUR AND TIMESTAMP '{NOW}')),
k AS (SELECT {LINK_KEY.format("url")} AS key, url, page_id // 40 AS map FROM f)
SELECT key, arg_min(url, (map, url)) AS loc FROM k WHERE key <> '' GROUP BY key""")
def sitemap_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations of all sitemaps in a section and, where dated, of the last ten days; one a normal address, from the first sitemap that has it."""
    pages = read_table(spark, sf_dir, "pages")
    at = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("<lastmod>"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(page_id * 41 % 43200 as int), 0)").cast("string"), F.lit("</lastmod>"))).otherwise("")
    entry = F.concat(F.lit("<url><loc>"), "url", F.lit("</loc>"), at, F.lit("</url>"))
    maps = pages.groupBy(F.floor(F.col("page_id") / 40).alias("map")).agg(F.array_join(F.collect_list(entry), "\n").alias("xml"))
    rows = html.sitemap_locations(maps, "map", "xml").withColumn("at", F.nullif("lastmod", F.lit("")).cast("timestamp_ntz"))
    now = F.lit(NOW).cast("timestamp_ntz")
    rows = rows.where(F.col("loc").rlike("/(en|de|fr)/") & (F.col("at").isNull() | F.col("at").between(now - F.make_dt_interval(hours=F.lit(240)), now)))
    return rows.withColumn("key", urls.key(F.col("loc"))).where("key <> ''").groupBy("key").agg(F.min_by("loc", F.struct("sitemap", "loc")).alias("loc"))


@query(SQL + f""", t AS (SELECT doc_id, captured, score, {TOKENS.format('title')} AS ts FROM stories),
k AS (SELECT * FROM t WHERE score >= 50 AND captured BETWEEN TIMESTAMP '{NOW}' - INTERVAL 720 HOUR AND TIMESTAMP '{NOW}' AND len(ts) > 0),
m AS (SELECT a.doc_id, b.doc_id AS b, b.captured FROM t a JOIN k b ON a.score < 50 AND len(a.ts) > 0 AND len(list_intersect(a.ts, b.ts)) / (len(a.ts) + len(b.ts) - len(list_intersect(a.ts, b.ts))) >= 0.7)
SELECT doc_id, arg_max(b, (captured, b)) AS newest, min(b) AS first FROM m GROUP BY doc_id""")
def published_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest and the first title published within 30 days that shares 0.7 or more of its tokens with a story's."""
    rows = stories(spark, sf_dir).select(F.col("doc_id").alias("id"), text.tokens(F.col("title")).alias("ts"), F.col("captured").alias("at"), "score")
    now = F.lit(NOW).cast("timestamp_ntz")
    known = rows.where("score >= 50").where(F.col("at").between(now - F.make_dt_interval(hours=F.lit(720)), now)).drop("score")
    return scan.newest_and_first_match(rows.where("score < 50").select("id", "ts"), known, 0.7).withColumnRenamed("id", "doc_id")


@query(f"""WITH k AS (SELECT user_id, max(ts) AS latest FROM events WHERE event_type = 'purchase' GROUP BY user_id HAVING max(ts) >= TIMESTAMP '{NOW}' - INTERVAL 48 HOUR)
SELECT e.event_id, k.latest FROM events e JOIN k USING (user_id) WHERE e.event_type <> 'purchase'""")
def recently_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose key was last published 48 hours before now or later, with that time."""
    events = read_table(spark, sf_dir, "events")
    latest = events.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("latest"))
    latest = latest.where(F.col("latest") >= F.lit(NOW).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(48)))
    return events.where("event_type <> 'purchase'").join(latest, "user_id").select("event_id", "latest")


SAID = "array_to_string(list_filter(list_transform(regexp_extract_all({0}, '(?is)<p[^>]*>(.*?)</p>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))), lambda x: length(x) >= 35 AND len(string_split(x, ' ')) >= 6), ' ')"


@query(f"""WITH p AS (SELECT page_id, {SAID.format("html")} AS body, {SAID.format("regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1)")} AS element FROM pages),
c AS (SELECT page_id, CASE WHEN page_id % 4 = 0 AND length(body) >= 200 THEN 'json_ld' WHEN page_id % 4 = 1 AND length(body) >= 200 THEN 'itemprop' WHEN page_id % 4 <> 3 AND length(element) >= 200 THEN 'article' WHEN body <> '' THEN 'paragraphs' ELSE 'none' END AS strategy, body, element FROM p)
SELECT page_id, strategy, md5(CASE strategy WHEN 'article' THEN element WHEN 'none' THEN '' ELSE body END) AS said FROM c""")
def article_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's body by the first strategy that gives 200 characters: linked data, marked body, article element, else all paragraphs."""
    pages = read_table(spark, sf_dir, "pages").withColumn("body", F.array_join(html.paragraphs(F.col("html")), " "))
    data = F.concat(F.lit('<script type="application/ld+json">'), F.to_json(F.struct(F.lit("NewsArticle").alias("@type"), F.col("body").alias("articleBody"))), F.lit("</script>"))
    marked = F.concat(F.lit('<div itemprop="articleBody">'), "body", F.lit("</div>"))
    kind = F.col("page_id") % 4
    seen = F.when(kind == 0, F.concat(data, "html")).when(kind == 1, F.concat(marked, "html")).when(kind == 3, F.regexp_replace("html", "(?i)</?article[^>]*>", "")).otherwise(F.col("html"))
    found = html.article(seen)
    return pages.select("page_id", found.alias("a")).select("page_id", "a.strategy", F.md5("a.body").alias("said"))


@query(SQL + """, b AS (SELECT doc_id, source, captured::DATE AS day, score FROM stories),
s AS (SELECT *, max(score) OVER (PARTITION BY source, day) AS best, row_number() OVER (PARTITION BY source, day ORDER BY score DESC, doc_id) AS r FROM b)
SELECT doc_id, source, day, score FROM s WHERE best < 90 AND r <= 3""")
def low_score_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three best stories of each source and day that put nothing into the queue."""
    rows = stories(spark, sf_dir).select("doc_id", "source", F.col("captured").cast("date").alias("day"), "score")
    batch = rows.groupBy("source", "day").agg(F.max("score").alias("best")).where("best < 90").drop("best")
    rank = F.row_number().over(Window.partitionBy("source", "day").orderBy(F.desc("score"), "doc_id"))
    return rows.join(batch, ["source", "day"], "left_semi").withColumn("r", rank).where("r <= 3").select("doc_id", "source", "day", "score")
