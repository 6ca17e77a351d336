"""URLs as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_name", "fbclid", "gclid", "mc_cid", "mc_eid")
#: Endings of files that are no articles.
ASSETS = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".pdf", ".zip", ".mp4", ".mp3")
#: Path parts of articles and of other pages.
GOOD = (
    "story", "article", "feature", "featured", "news", "noticia", "noticias", "materia", "matéria", "politica", "policia", "cidade", "cidades",
    "estado", "rio-de-janeiro", "norte-fluminense", "campos", "macae", "sao-joao-da-barra", "economia", "geral", "brasil",
)
BAD = (
    "careers", "contact", "about", "faq", "terms", "privacy", "advert", "preferences", "feedback", "account", "subscribe", "donate", "shop",
    "admin", "login", "cadastro", "newsletter", "tag", "tags", "author", "autores", "categoria", "category", "wp-content", "uploads", "assets",
    "politica-de-privacidade", "quem-somos", "fale-conosco",
)
DATED = r"[^0-9A-Za-z_](19|20)[0-9]{2}[./_-]?[01]?[0-9][./_-]?"


def host(url: Column) -> Column:
    """Lower-cased host without ``www.``."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def clean(url: Column) -> Column:
    """Lower-cased scheme and host, single slashes, no fragment, no tracking parameters, no last slash."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    place = F.regexp_replace(F.regexp_replace(path(url), "/+", "/"), "/$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING))
    tail = F.array_join(kept, "&")
    name = F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1))
    return F.concat(scheme, F.lit("://"), name, place, F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise(""))


def key(url: Column) -> Column:
    """Host without ``www.`` and path, lower case, no last slash."""
    return F.lower(F.concat(host(url), F.regexp_replace(path(url), "/+$", "")))


def looks_like_article(url: Column) -> Column:
    """A web address with a path that names no asset or service page and has a date, a news part or a long slug."""
    parts = F.filter(F.split(F.lower(path(url)), "/"), lambda p: p != "")
    last = F.coalesce(F.get(F.reverse(parts), F.lit(0)), F.lit(""))
    asset = F.lower(url).rlike("(" + "|".join(ASSETS).replace(".", "[.]") + ")")
    web = url.startswith("http://") | url.startswith("https://")
    named = F.arrays_overlap(parts, F.array(*map(F.lit, GOOD)))
    long = (F.length(last) >= 25) & (F.length(last) - F.length(F.replace(last, F.lit("-"), F.lit(""))) >= 3)
    bad = F.arrays_overlap(F.slice(parts, 1, 3), F.array(*map(F.lit, BAD)))
    fits = web & (host(url) != "") & (F.size(parts) > 0) & ~asset & ~bad & (path(url).rlike(DATED) | named | long)
    return F.coalesce(fits, F.lit(False))


def source_kind(url: Column) -> Column:
    """Kind of a source by its address: blank, sitemap, feed, mobile, else html; null is blank."""
    low = F.lower(F.coalesce(url, F.lit("")))
    kinds = F.when(F.trim(low) == "", "blank").when(low.rlike("[.]xml|sitemap"), "sitemap").when(low.rlike("feed|rss|atom"), "feed")
    return kinds.when(low.rlike("://m[.]"), "mobile").otherwise("html")


def variants(url: Column) -> Column:
    """Alternates in the order of trial: as it is, desktop host, bare host, accelerated and print page."""
    base = F.regexp_replace(F.regexp_extract(url, r"^[^?#]*", 0), "/+$", "")
    forms = (base, F.regexp_replace(base, r"://m\.", "://www."), F.regexp_replace(base, r"://(www\.|m\.)", "://"), F.concat(base, F.lit("/amp")), F.concat(base, F.lit("?print=1")))
    return F.array(*forms)


def secure(url: Column, prefixes: str = "utm_|fbclid|gclid|ref|src|mc_") -> Column:
    """Secure scheme, lower-cased host, no fragment and no parameter whose name starts with one of the prefixes."""
    kept = F.filter(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).rlike(f"^({prefixes})"))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.concat(F.lit("https://"), F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), path(url), tail)


def slug_title(path: Column) -> Column:
    """The last part of a path with separators as spaces, its first letter a capital."""
    said = F.regexp_replace(F.regexp_extract(F.regexp_replace(path, "/+$", ""), "[^/]*$", 0), "[-_.]+", " ")
    return F.concat(F.upper(F.substring(said, 1, 1)), F.substring(said, 2, 1 << 30))
