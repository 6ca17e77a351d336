"""Discovery over pages as a closed web: phases with caps, levels of links, and extraction until a text is long enough."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import jsons
from tidewire.operators import discover
from tidewire.plans.registry import query
from tidewire.session import read_table

#: Phases of discovery and the pages that are their candidates; a page can be one of several.
PHASES = (("feed", "page_id % 4 = 0"), ("search", "page_id % 6 = 1"), ("sitemap", "page_id % 3 = 0"), ("home", "page_id % 5 < 2"), ("section", "page_id % 2 = 1"), ("watch", "page_id % 7 < 5"))
CAP = 30


def _phases_sql() -> str:
    steps, taken = [], ""
    for i, (name, test) in enumerate(PHASES):
        unseen = f" AND url NOT IN (SELECT url FROM p{i - 1}a)" if i else ""
        steps.append(f"p{i} AS (SELECT url, '{name}' AS phase, row_number() OVER (ORDER BY o, url) AS place FROM (SELECT url, min(page_id) AS o FROM pages WHERE {test} AND coalesce(url, '') <> ''{unseen} GROUP BY url) ORDER BY o, url LIMIT {CAP})")
        taken = f"SELECT * FROM p{i}" if not i else f"SELECT * FROM p{i - 1}a UNION ALL SELECT * FROM p{i}"
        steps.append(f"p{i}a AS MATERIALIZED ({taken})")
    return "WITH " + ", ".join(steps) + f" SELECT url, phase, place::INTEGER AS place FROM p{len(PHASES) - 1}a"


@query(_phases_sql())
def phased_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What six phases with a cap each take of the pages (the cap is the feature), none of them twice."""
    pages = read_table(spark, sf_dir, "pages")
    return discover.in_phases([(name, pages.where(test), CAP) for name, test in PHASES], "url", ("page_id",))


@query("""WITH RECURSIVE w AS (SELECT page_id, length(regexp_replace(coalesce(html, ''), '<[^>]*>', '', 'g')) < 12000 AS goes FROM pages), n AS (SELECT count(*) AS n FROM pages),
l AS (SELECT page_id, unnest([(page_id * 3 + 1) % n, (page_id * 7 + 5) % n, page_id + 1]) AS link FROM w, n WHERE goes),
e AS (SELECT DISTINCT l.page_id, link FROM l JOIN w ON w.page_id = l.link),
r(page_id, level) AS (SELECT page_id, 0 FROM w WHERE page_id % 97 = 0 UNION SELECT e.link, level + 1 FROM r JOIN e USING (page_id) WHERE level < 6)
SELECT page_id, min(level) AS level FROM r GROUP BY page_id""")
def page_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages within six links of the first ones, each at its least number of links; pages with a long text are not followed."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", F.length(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", "")).alias("useful"))
    n = pages.count()
    web = pages.withColumn("links", F.array((F.col("page_id") * 3 + 1) % n, (F.col("page_id") * 7 + 5) % n, F.col("page_id") + 1))
    return discover.by_levels(web, web.where("page_id % 97 = 0"), "page_id", "links", 6, goes_on=F.col("useful") < 12_000)


@query("""WITH s AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN regexp_replace(coalesce(html, ''), '[^A-Za-z0-9.]+', ' ', 'g') END AS a, left(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'), (page_id % 40 * 60)::INT) AS b, regexp_replace(coalesce(html, ''), '[^a-z ]+', '', 'g') AS c FROM pages),
n AS (SELECT *, coalesce(length(a), 0) AS na, length(b) AS nb, length(c) AS nc FROM s),
k AS (SELECT *, CASE WHEN na >= 1800 THEN 1 WHEN greatest(na, nb) >= 1800 THEN 2 ELSE 3 END AS tried FROM n),
m AS (SELECT *, greatest(na, CASE WHEN tried > 1 THEN nb ELSE 0 END, CASE WHEN tried > 2 THEN nc ELSE 0 END) AS useful FROM k)
SELECT page_id, CASE WHEN useful = 0 THEN NULL WHEN na = useful THEN 'data' WHEN tried > 1 AND nb = useful THEN 'marks' ELSE 'words' END AS strategy, useful, tried,
  md5(CASE WHEN useful = 0 THEN NULL WHEN na = useful THEN a WHEN tried > 1 AND nb = useful THEN b ELSE c END) AS said FROM m""".replace("\\\\", "\\"))
def extraction_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages read by one strategy after the other until one gives 1,800 characters; else by the one that gives most."""
    text = F.coalesce("html", F.lit(""))
    body = F.when(F.col("page_id") % 3 == 0, F.regexp_replace(text, "[^A-Za-z0-9.]+", " "))
    data = F.concat(F.lit('<script type="application/ld+json">{"@type":"Article","headline":"h","articleBody":"'), body, F.lit('"}</script>'))
    told = jsons.member(F.from_json(jsons.first_object(jsons.linked_data(data), jsons.typed("Article")), "map<string,string>"), "articleBody")
    marks = F.substring(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), r"\s+", " "), F.lit(1), (F.col("page_id") % 40 * 60).cast("int"))
    found = discover.extract_until([("data", told), ("marks", marks), ("words", F.regexp_replace(text, "[^a-z ]+", ""))])
    return read_table(spark, sf_dir, "pages").select("page_id", found.alias("f")).select("page_id", "f.strategy", "f.useful", "f.tried", F.md5("f.text").alias("said"))
