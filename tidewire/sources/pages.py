"""Feeds and pages given as text columns: tolerant parsing with Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def without_scripts(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " "))


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def language(html: Column) -> Column:
    return F.regexp_extract(html, r'(?i)<html[^>]*lang="([^"]*)"', 1)


def paragraphs(html: Column, chars: int = 35, words: int = 6) -> Column:
    found = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1)), strip_tags)
    return F.filter(found, lambda p: (F.length(p) >= chars) & (F.size(F.split(p, " ")) >= words))


def links(url: Column, html: Column) -> Column:
    """Distinct link targets, relative ones joined to the host; anchors, scripts, mail and phone links left out."""
    root = F.regexp_extract(url, r"^[a-z]+://[^/?#]*", 0)
    found = F.array_distinct(F.regexp_extract_all(html, F.lit(r'(?i)<a[^>]*?href="([^"]*)"'), F.lit(1)))
    kept = F.filter(found, lambda h: (h != "") & ~h.rlike("^(#|javascript:|mailto:|tel:)"))
    return F.transform(kept, lambda h: F.when(h.startswith("/"), F.concat(root, h)).otherwise(h))


def _tag(item: Column, *names: str) -> Column:
    """Text of the first of the tags that is there and not blank, CDATA marks dropped."""
    return F.coalesce(*[F.nullif(F.trim(F.regexp_replace(F.regexp_extract(item, rf"(?is)<{n}[^>]*>(.*?)</{n}>", 1), r"<!\[CDATA\[|\]\]>", "")), F.lit("")) for n in names], F.lit(""))


def feed_items(feeds: DataFrame, name_col: str, xml_col: str, per_feed: int | None = None) -> DataFrame:
    """(feed, place, title, link, summary, date): items and entries of RSS and Atom texts.

    Links fall back to an href and then to the guid. Items without title and link are dropped; of
    items with one link, else one title, the first stays; ``per_feed`` is the feature that caps a feed.
    """
    item = F.regexp_extract_all(xml_col, F.lit(r"(?is)<(?:item|entry)[\s>].*?</(?:item|entry)>"), F.lit(0))
    rows = feeds.select(F.col(name_col).alias("feed"), F.posexplode(item).alias("place", "item"))
    link = F.coalesce(F.nullif(_tag(F.col("item"), "link"), F.lit("")), F.nullif(F.regexp_extract("item", r'(?is)<link[^>]*href="([^"]*)"', 1), F.lit("")), _tag(F.col("item"), "guid"))
    made = rows.select(
        "feed", "place", strip_tags(_tag(F.col("item"), "title")).alias("title"), link.alias("link"),
        strip_tags(_tag(F.col("item"), "description", "summary", "content")).alias("summary"),
        _tag(F.col("item"), "pubDate", "published", "updated", "dc:date").alias("date"),
    ).where("title <> '' and link <> ''")
    best = made.groupBy("feed", F.coalesce(F.nullif("link", F.lit("")), F.col("title")).alias("_k")).agg(F.min(F.struct("place", "title", "link", "summary", "date")).alias("b"))
    out = best.select("feed", "b.*")
    if per_feed is None:
        return out
    from tidewire.operators.ranking import top_per_key

    return top_per_key(out, "feed", per_feed, F.col("place"))


def sitemap_locations(maps: DataFrame, name_col: str, xml_col: str) -> DataFrame:
    """(sitemap, loc, lastmod): distinct locations of sitemap texts, files of assets left out."""
    entry = F.regexp_extract_all(xml_col, F.lit(r"(?is)<(?:\w+:)?url[\s>].*?</(?:\w+:)?url>"), F.lit(0))
    rows = maps.select(F.col(name_col).alias("sitemap"), F.explode(entry).alias("e"))
    rows = rows.select("sitemap", _tag(F.col("e"), "loc").alias("loc"), _tag(F.col("e"), "lastmod").alias("lastmod"))
    return rows.where("loc <> ''").where(~F.lower("loc").rlike(r"[.](jpg|jpeg|png|gif|webp|svg|pdf|zip|mp4|mp3)")).groupBy("sitemap", "loc").agg(F.max("lastmod").alias("lastmod"))


def article(html: Column, least: int = 200) -> Column:
    """struct(strategy, body): a page's body by the first strategy that gives ``least`` characters.

    In order: ``articleBody`` of linked data, the element marked so, paragraphs of the article element,
    and all paragraphs, however short; ``none`` and an empty body where a page has none. Linked data that is
    no JSON object is passed over; a null page has none.
    """
    scripts = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    data = F.array_max(F.filter(F.transform(scripts, lambda s: F.get_json_object(s, "$.articleBody")), lambda b: b.isNotNull()))
    marked = strip_tags(F.regexp_extract(html, r'(?is)<(div|section|article)[^>]*itemprop="articleBody"[^>]*>(.*?)</\1>', 2))
    element = F.array_join(paragraphs(F.regexp_extract(html, r"(?is)<article[^>]*>(.*?)</article>", 1)), " ")
    every = F.array_join(paragraphs(html), " ")
    tried = F.array(*[F.struct(F.lit(n).alias("strategy"), b.alias("body")) for n, b in (("json_ld", data), ("itemprop", marked), ("article", element))])
    long = F.get(F.filter(tried, lambda t: F.length(t["body"]) >= least), 0)
    rest = F.when(every != "", F.struct(F.lit("paragraphs").alias("strategy"), every.alias("body"))).otherwise(F.struct(F.lit("none").alias("strategy"), F.lit("").alias("body")))
    return F.coalesce(long, rest)
