"""URLs, pages and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import urls
from tidewire.plans.registry import query
from tidewire.plans.stories import LINK_KEY
from tidewire.session import read_table
from tidewire.sources import pages as html


@query(f"SELECT page_id, {LINK_KEY.format('url')} AS key, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', '') AS host FROM pages")
def url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", urls.key(F.col("url")).alias("key"), urls.host(F.col("url")).alias("host"))


@query(r"""WITH u AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) || regexp_replace(regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+', '/', 'g'), '/$', '') AS base,
  array_to_string(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT lower(split_part(p, '=', 1)) IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'utm_id', 'utm_name', 'fbclid', 'gclid', 'mc_cid', 'mc_eid')), '&') AS q FROM pages)
SELECT page_id, base || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS url FROM u""")
def clean_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", urls.clean(F.col("url")).alias("url"))


_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"


@query(f"""WITH p AS (SELECT page_id, url, regexp_extract(url, '://([^/?#]*)', 1) AS h, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
c AS (SELECT *, list_filter(string_split(lower(path), '/'), lambda x: x <> '') AS parts FROM p)
SELECT page_id, (starts_with(url, 'http://') OR starts_with(url, 'https://')) AND h <> '' AND len(parts) > 0 AND NOT regexp_matches(lower(url), '[.](jpg|jpeg|png|gif|webp|svg|pdf|zip|mp4|mp3)')
  AND NOT list_has_any(parts[1:3], {_LIST(urls.BAD)}) AND (regexp_matches(path, '{urls.DATED}') OR list_has_any(parts, {_LIST(urls.GOOD)}) OR (length(parts[-1]) >= 25 AND length(parts[-1]) - length(replace(parts[-1], '-', '')) >= 3)) AS article FROM c""")
def article_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page's address looks like an article's."""
    return read_table(spark, sf_dir, "pages").select("page_id", urls.looks_like_article(F.col("url")).alias("article"))


@query(r"""WITH l AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') AS root, unnest(list_distinct(regexp_extract_all(html, '(?i)<a[^>]*?href="([^"]*)"', 1))) AS href FROM pages)
SELECT page_id, CASE WHEN starts_with(href, '/') THEN root || href ELSE href END AS link FROM l WHERE href <> '' AND NOT regexp_matches(href, '^(#|javascript:|mailto:|tel:)')""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct links of every page, relative ones made absolute."""
    rows = read_table(spark, sf_dir, "pages").select("page_id", F.explode(html.links(F.col("url"), F.col("html"))).alias("link"))
    return rows


@query(r"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, regexp_extract(html, '(?i)<html[^>]*lang="([^"]*)"', 1) AS lang FROM pages""")
def page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "pages")
    return rows.select("page_id", html.title(F.col("html")).alias("title"), html.language(F.col("html")).alias("lang"))


@query(r"""WITH p AS (SELECT page_id, list_transform(regexp_extract_all(html, '(?is)<p[^>]*>(.*?)</p>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS ps FROM pages)
SELECT page_id, len(list_filter(ps, lambda x: length(x) >= 35 AND len(string_split(x, ' ')) >= 6)) AS paragraphs, coalesce(list_sum(list_transform(list_filter(ps, lambda x: length(x) >= 35 AND len(string_split(x, ' ')) >= 6), lambda x: length(x))), 0)::BIGINT AS chars FROM p""")
def page_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of 35 characters and six words or more."""
    rows = read_table(spark, sf_dir, "pages").select("page_id", html.paragraphs(F.col("html")).alias("ps"))
    return rows.select("page_id", F.size("ps").cast("long").alias("paragraphs"), F.aggregate("ps", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))


@query(r"""WITH t AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g') AS h FROM pages)
SELECT page_id, length(trim(regexp_replace(regexp_replace(h, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS text_chars, len(regexp_extract_all(h, '<[^>]*>')) AS tags FROM t""")
def text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of text and number of tags of every page."""
    body = html.without_scripts(F.col("html"))
    return read_table(spark, sf_dir, "pages").select("page_id", F.length(html.strip_tags(body)).cast("long").alias("text_chars"), F.regexp_count(body, F.lit("<[^>]*>")).cast("long").alias("tags"))


@query(r"""SELECT host, count(*) AS pages, count(DISTINCT key) AS keys FROM (SELECT regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\.', '') AS host, """ + LINK_KEY.format("url") + r""" AS key FROM pages) WHERE NOT host IN ('ththre.example.com', 'therha.example.com') AND host <> '' GROUP BY host""")
def blacklisted_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and keys of each host that is not on the black list; blank hosts count as listed."""
    rows = read_table(spark, sf_dir, "pages").select(urls.host(F.col("url")).alias("host"), urls.key(F.col("url")).alias("key"))
    rows = rows.where((F.col("host") != "") & ~F.col("host").isin("ththre.example.com", "therha.example.com"))
    return rows.groupBy("host").agg(F.count("*").alias("pages"), F.count_distinct("key").alias("keys"))
