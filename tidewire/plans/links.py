"""Kinds, variants and normal forms of addresses, and what pages say about themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import urls
from tidewire.operators.classify import clamp
from tidewire.plans.registry import query
from tidewire.session import read_table
from tidewire.sources import pages as html


@query(r"""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN trim(url) = '' THEN 'blank' WHEN regexp_matches(lower(url), '[.]xml|sitemap') THEN 'sitemap' WHEN regexp_matches(lower(url), 'feed|rss|atom') THEN 'feed' WHEN regexp_matches(lower(url), '://m[.]') THEN 'mobile' ELSE 'html' END AS kind FROM pages) GROUP BY kind""")
def source_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the kind that their address shows."""
    return read_table(spark, sf_dir, "pages").groupBy(urls.source_kind(F.col("url")).alias("kind")).agg(F.count("*").alias("n"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[^?#]*') AS base FROM pages), b AS (SELECT page_id, regexp_replace(base, '/+$', '') AS b FROM p),
v AS (SELECT page_id, unnest([b, regexp_replace(b, '://m\.', '://www.'), regexp_replace(b, '://(www\.|m\.)', '://'), b || '/amp', b || '?print=1']) AS variant, unnest([1, 2, 3, 4, 5]) AS place FROM b)
SELECT page_id, variant, min(place)::INT AS place FROM v GROUP BY page_id, variant""")
def url_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct alternates of each address and the place of each in the order of trial."""
    rows = read_table(spark, sf_dir, "pages").select("page_id", F.posexplode(urls.variants(F.col("url"))).alias("place", "variant"))
    return rows.groupBy("page_id", "variant").agg((F.min("place") + 1).alias("place"))


@query(r"""WITH p AS (SELECT page_id, url, list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(split_part(x, '=', 1)), '^(utm_|fbclid|gclid|ref|src|mc_)')) AS q FROM pages)
SELECT page_id, 'https://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) || regexp_extract(url, '://[^/?#]*([^?#]*)', 1) || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url FROM p""")
def library_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses with the secure scheme, without fragments and without parameters whose names start with a tracking prefix."""
    return read_table(spark, sf_dir, "pages").select("page_id", urls.secure(F.col("url")).alias("url"))


@query(r"""WITH b AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g') AS h FROM pages),
c AS (SELECT page_id, length(trim(regexp_replace(regexp_replace(h, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS chars, coalesce(list_sum(list_transform(regexp_extract_all(h, '(?is)<a\s[^>]*>(.*?)</a>', 1), lambda x: length(trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))))), 0) AS linked FROM b)
SELECT page_id, linked::BIGINT AS linked, round(least(1.0, linked / greatest(chars, 1)), 6) AS density FROM c""")
def link_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters inside links and their share of a page's text, one at most."""
    body = html.without_scripts(F.col("html"))
    anchors = F.regexp_extract_all(body, F.lit(r"(?is)<a\s[^>]*>(.*?)</a>"), F.lit(1))
    linked = F.aggregate(anchors, F.lit(0).cast("long"), lambda a, x: a + F.length(html.strip_tags(x)))
    rows = read_table(spark, sf_dir, "pages").select("page_id", linked.alias("linked"), F.length(html.strip_tags(body)).alias("chars"))
    share = F.least(F.lit(1.0), F.col("linked") / F.greatest("chars", F.lit(1)))
    return rows.select("page_id", "linked", F.round(share, 6).alias("density"))


@query(r"""WITH b AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g') AS h FROM pages), p AS (SELECT page_id, h, list_transform(regexp_extract_all(h, '(?is)<p[^>]*>(.*?)</p>', 1), lambda x: length(trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')))) AS ps FROM b)
SELECT page_id, least(100000, greatest(-100000, coalesce(list_sum(ps), 0) // 8 + 80 * len(ps) + CASE WHEN regexp_matches(h, '(?i)<article') THEN 350 ELSE 0 END - CASE WHEN regexp_matches(h, '(?i)class="(ad|promo|sponsor)') THEN 500 ELSE 0 END))::INT AS score FROM p""")
def container_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of an article each page's body is: text, paragraphs, an article element; less for advertising."""
    body = html.without_scripts(F.col("html"))
    lengths = F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1)), lambda x: F.length(html.strip_tags(x)))
    rows = read_table(spark, sf_dir, "pages").select("page_id", lengths.alias("ps"), body.rlike("(?i)<article").alias("article"), body.rlike('(?i)class="(ad|promo|sponsor)').alias("sold"))
    chars = F.aggregate("ps", F.lit(0).cast("long"), lambda a, x: a + x)
    score = F.floor(chars / 8) + 80 * F.size("ps") + F.when(F.col("article"), 350).otherwise(0) - F.when(F.col("sold"), 500).otherwise(0)
    return rows.select("page_id", clamp(score, -100000, 100000).cast("int").alias("score"))


@query(r"""SELECT page_id, len(string_split(path, '/')) - 1 AS depth, upper(substr(s, 1, 1)) || substr(s, 2) AS title FROM (SELECT page_id, path, regexp_replace(regexp_extract(regexp_replace(path, '/+$', ''), '[^/]*$'), '[-_.]+', ' ', 'g') AS s FROM (SELECT page_id, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages))""")
def slug_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title read from the last part of an address."""
    rows = read_table(spark, sf_dir, "pages").select("page_id", urls.path(F.col("url")).alias("path"))
    return rows.select("page_id", (F.size(F.split("path", "/")) - 1).cast("long").alias("depth"), urls.slug_title(F.col("path")).alias("title"))
