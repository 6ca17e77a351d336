"""URL filters: host and path rules, and block decisions that spread over redirects and canonical links."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import Scratch
from tidewire.llm.components import connected_components


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: Up to so many rules are compiled into the plan; more are joined by host.
COMPILED_RULES = 1000
LINK, META = r"(?is)<link\b[^>]*>", r"(?is)<meta\b[^>]*>"
IS_CANONICAL = r"""(?is)\brel\s*=\s*(?:"[^"]*\bcanonical\b|'[^']*\bcanonical\b|canonical\b)"""
IS_REFRESH = r"""(?is)\bhttp-equiv\s*=\s*["']?refresh\b"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
MOVED = r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _order(rules: Sequence[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: (-len(r.host + r.path), r.verdict))


def _compiled_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    fits = [
        F.when(
            ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path),
            F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict")),
        )
        for r in _order(rules)
    ]
    return F.coalesce(*fits)


def with_best_rule(rows: DataFrame, rules: Sequence[Rule], compiled: int = COMPILED_RULES) -> DataFrame:
    """Adds ``best``, a struct (rule, verdict) of the longest rule that fits columns host and path, or null; of equally long ones an allow wins.

    More than ``compiled`` rules are a table: the distinct hosts' suffixes meet the rules by host,
    and each host gets the list of its rules in order.
    """
    if len(rules) <= compiled:
        return rows.withColumn("best", _compiled_rule(F.col("host"), F.col("path"), rules))
    known = rows.sparkSession.createDataFrame([(r.host, k, r.path, r.host + r.path, r.verdict) for k, r in enumerate(_order(rules))], "suffix string, place int, start string, rule string, verdict string")
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    hosts = rows.select("host").distinct().select("host", F.explode(suffixes).alias("suffix")).join(known, "suffix")
    own = hosts.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("place", "start", "rule", "verdict"))).alias("own"))
    first = F.get(F.filter("own", lambda r: F.col("path").startswith(r["start"])), 0)
    return rows.join(own, "host", "left").withColumn("best", F.when(first.isNotNull(), F.struct(first["rule"].alias("rule"), first["verdict"].alias("verdict")))).drop("own")


def node_key(url: Column) -> Column:
    """Scheme-free address with its fragment and default port cut, ``/`` for an empty path: what a redirect or canonical link points at."""
    tail = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    host = host_of(url)
    host = F.when(F.rlike(url, F.lit("^(?i)http://")), F.regexp_replace(host, ":80$", "")).when(F.rlike(url, F.lit("^(?i)https://")), F.regexp_replace(host, ":443$", "")).otherwise(host)
    return F.when(url.contains("://"), F.concat(host, F.when(tail.startswith("/"), F.lit("")).otherwise(F.lit("/")), tail))


def _without_dots(path: Column) -> Column:
    """A path whose segments ``.`` and ``..`` are resolved."""
    parts = F.split(F.concat(path, F.when(F.rlike(path, F.lit(r"/\.\.?$")), F.lit("/")).otherwise(F.lit(""))), "/")
    return F.aggregate(
        F.slice(parts, 2, F.size(parts)),
        F.lit(""),
        lambda done, x: F.when(x == ".", done).when(x == "..", F.regexp_replace(done, "/[^/]*$", "")).otherwise(F.concat(done, F.lit("/"), x)),
    )


def target_key(url: Column, link: Column) -> Column:
    """Key of a link's target, absolute or relative to the page; null where it is of another scheme or has no page."""
    link = F.regexp_replace(link, r"(?i)&(?:amp|#38|#x26);", "&")
    site = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    path = path_of(url)
    folder = F.regexp_replace(F.when(path == "", "/").otherwise(path), "[^/]*$", "")
    at, rest = F.regexp_extract(link, "(?s)^([^?#]*)", 1), F.regexp_extract(link, "(?s)^[^?#]*(.*)$", 1)
    full = (
        F.when(F.rlike(link, F.lit("^[A-Za-z][A-Za-z0-9+.-]*://")), link)
        .when(F.rlike(link, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")), F.lit(None))
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(at == "", F.concat(site, path, rest))
        .when(link.startswith("/"), F.concat(site, _without_dots(at), rest))
        .otherwise(F.concat(site, _without_dots(F.concat(folder, at)), rest))
    )
    return F.when(url.contains("://"), node_key(full))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, host, path, rule, verdict): one row for each row of ``pages``.

    A page's own rule decides. Pages without one take the decision of their class of aliases, the
    connected component over all redirect (meta refresh) and canonical links: block if an address in it
    is blocked by a rule and none is allowed by one (an explicit allow has precedence), else allow.
    Links may be relative to their page; ``http://a`` and ``http://a:80/#x`` are one address.
    Null url: empty host and path, no rule, allow. Null html: no links. Repeated rows are judged
    each; links to oneself and to other schemes count as none. Other columns are not read. An
    empty table gives an empty result.
    """
    scratch = Scratch(pages.sparkSession, "url-filter")
    url, html = F.col("url"), F.col("html")
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def targets(tag: str, kind: str, place: str) -> Column:
        tags = F.filter(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda t: F.rlike(t, F.lit(kind)))
        return F.filter(F.transform(tags, lambda t: F.regexp_extract(t, place, 1)), lambda t: t != "")

    links = F.concat(targets(LINK, IS_CANONICAL, HREF), targets(META, IS_REFRESH, MOVED))
    edges = own.select("url", F.explode(links).alias("link")).select(node_key(url).alias("a"), target_key(url, F.col("link")).alias("b"))
    classes = scratch.keep(connected_components(scratch, edges), "classes")

    # an address is its host and tail: the tail up to the query is the path
    at = F.col("node")
    ruled = with_best_rule(classes.withColumns({"host": F.regexp_extract(at, r"^[^/?]*", 0), "path": F.regexp_extract(at, r"(?s)^[^/?]*([^?]*)", 1)}), rules)
    spread = (
        ruled.withColumn("own", F.col("best.verdict"))
        .groupBy("component")
        .agg(F.max(F.col("own") == "allow").alias("allowed"), F.max(F.col("own") == "block").alias("blocked"))
        .where("blocked and not coalesce(allowed, false)")
        .select("component")
    )
    blocked = classes.join(spread, "component").select("node", F.lit(True).alias("hit"))
    joined = own.select("id", node_key(url).alias("node"), host_of(url).alias("host"), path_of(url).alias("path")).join(blocked, "node", "left")
    return with_best_rule(joined, rules).select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.when(F.col("hit"), "block"), F.lit("allow")).alias("verdict"),
    )
