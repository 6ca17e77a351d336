"""Articles in pages' embedded JSON and linked data, over pages with scripts that Spark builds from them; broken JSON made whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import jsons
from tidewire.plans.registry import query
from tidewire.session import read_table

#: Embedded states by page_id % 6, with the page's digest for {H} and its words for {B}: in a list before a name that sorts first, plain, broken off, deep, without a body, absent.
STATES = (
    '{"props":{"pageProps":{"z":[{"n":1},{"headline":"{H}","text":"{B}"}],"a":{"headline":"wrong","body":"w"}}}}',
    '{"props":{"pageProps":{"headline":"{H}","image":{"url":"https://i.example/{H}.jpg"},"body":"{B}"}}}',
    '{"props":{"headline":"{H}","body":"{B}"',
    '{"props":{"deep":[[[{"x":{"headline":"{H}","articleBody":"{B}","image":"{H}.png"}}]]],"headline":"only"}}',
    '{"props":{"headline":"{H}","other":"{B}"}}',
    "",
)
#: Linked data by page_id % 4: a list, a graph in the second script, a type among several, no such type.
LINKED = (
    ('[{"@type":"Organization","name":"x"},{"@type":"NewsArticle","headline":"{H}","articleBody":"{B}"}]', '{"@type":"NewsArticle","headline":"second"}'),
    ('{"@type":"WebSite","name":"{B}"}', '{"@context":"x","@graph":[{"@type":"Person"},{"@type":"Article","headline":"{H}","articleBody":"{B}"}]}'),
    ('{"@type":["Thing","Article"],"headline":"{H}","articleBody":"{B}","image":["{H}.png"]}', "{broken"),
    ('{"@type":"Event","name":"{B}"}', '{"headline":"{H}","articleBody":"{B}"}'),
)


def _filled(form: Column) -> Column:
    words = F.regexp_replace(F.coalesce("html", F.lit("")), "[^A-Za-z0-9.]+", " ")
    return F.replace(F.replace(form, F.lit("{H}"), F.md5(F.coalesce("url", F.lit("")))), F.lit("{B}"), words)


def _pick(forms: tuple[str, ...]) -> Column:
    return _filled(F.get(F.array(*map(F.lit, forms)), (F.col("page_id") % len(forms)).cast("int")))


def _sql(forms: tuple[str, ...]) -> str:
    return f"replace(replace([{', '.join(map(repr, forms))}][page_id % {len(forms)} + 1], '{{H}}', md5(coalesce(url, ''))), '{{B}}', regexp_replace(coalesce(html, ''), '[^A-Za-z0-9.]+', ' ', 'g'))"


def _said(body: str) -> str:
    return f"CASE WHEN length(trim({body})) > 20 THEN trim({body}) ELSE {body} END"


HAS = "json_exists(value, '$.headline') AND (json_exists(value, '$.body') OR json_exists(value, '$.articleBody') OR json_exists(value, '$.text'))"


@query(f"""WITH s AS (SELECT page_id, {_sql(STATES)} AS j FROM pages),
n AS (SELECT page_id, arg_min(t.value, t.id) AS o FROM (SELECT * FROM s WHERE json_valid(j)), LATERAL json_tree(j) t WHERE t.type = 'OBJECT' AND {HAS} GROUP BY page_id)
SELECT page_id, o ->> '$.headline' AS title, md5({_said("coalesce(o ->> '$.body', o ->> '$.articleBody', o ->> '$.text')")}) AS said, coalesce(o ->> '$.image.url', o ->> '$.image') AS image FROM s LEFT JOIN n USING (page_id)""")
def embedded_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first object with a headline and a body in a page's embedded state, at any depth and in the order of the document."""
    j = _pick(STATES)
    script = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), j, F.lit("</script>")))
    script = script.otherwise(F.concat(F.lit("<script>var a = 1;</script><SCRIPT>window.__NEXT_DATA__ = "), j, F.lit(";</SCRIPT>")))
    pages = read_table(spark, sf_dir, "pages").select("page_id", F.concat(F.coalesce("html", F.lit("")), script).alias("html"))
    found = pages.select("page_id", jsons.article(jsons.first_object(jsons.embedded_state(F.col("html")), jsons.has_article)).alias("a"))
    return found.select("page_id", "a.title", F.md5("a.body").alias("said"), "a.image")


@query(f"""WITH s AS (SELECT page_id, unnest([{_sql(tuple(a for a, _ in LINKED))}, {_sql(tuple(b for _, b in LINKED))}]) AS j, unnest([1, 2]) AS i FROM pages),
n AS (SELECT page_id, arg_min(t.value, (i, t.id)) AS o FROM (SELECT * FROM s WHERE json_valid(j)), LATERAL json_tree(j) t
  WHERE t.type = 'OBJECT' AND (value ->> '$."@type"' IN ('NewsArticle', 'Article') OR json_contains(json_extract(value, '$."@type"'), '"Article"') OR json_contains(json_extract(value, '$."@type"'), '"NewsArticle"')) GROUP BY page_id)
SELECT page_id, o ->> '$.headline' AS title, md5({_said("o ->> '$.articleBody'")}) AS said FROM pages LEFT JOIN n USING (page_id)""")
def linked_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first linked data of a page that is, or lists, an article's type, graphs included."""
    first, second = (_pick(tuple(x[k] for x in LINKED)) for k in (0, 1))
    script = lambda j: F.concat(F.lit("<script data-x type='application/ld+json'>\n"), j, F.lit("\n</script>"))
    pages = read_table(spark, sf_dir, "pages").select("page_id", F.concat(script(first), F.coalesce("html", F.lit("")), script(second)).alias("html"))
    found = pages.select("page_id", jsons.article(jsons.first_object(jsons.linked_data(F.col("html")), jsons.typed("NewsArticle", "Article"))).alias("a"))
    return found.select("page_id", "a.title", F.md5("a.body").alias("said"))


@query("""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l, length(text) AS n FROM documents WHERE text IS NOT NULL), k AS (SELECT doc_id, l, doc_id % 5 AS k, (doc_id * 7919) % (len(l) + 1) AS m FROM d)
SELECT doc_id, k = 0 AS whole, CASE WHEN k = 0 THEN len(l) ELSE m END AS n, md5(array_to_string(CASE WHEN k = 0 THEN l ELSE l[1:m] END, chr(10))) AS said FROM k""")
def json_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with an object of a document's lines: a fifth whole in fences, the others cut off within a line; the lines that are saved."""
    c = F.col
    docs = read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.split("text", "\n").alias("l"))
    docs = docs.withColumn("m", (c("doc_id") * 7919 % (F.size("l") + 1)).cast("int"))
    whole = F.concat(F.lit("Sure:\n```json\n"), F.to_json(F.struct(c("doc_id").alias("id"), c("l").alias("lines"))), F.lit("\n```\nDone {not that}."))
    head = F.to_json(F.struct(c("doc_id").alias("id"), F.slice("l", F.lit(1), c("m")).alias("lines")))
    cut = F.concat(F.regexp_replace(head, r"\]\}$", ""), F.when(c("m") > 0, ",").otherwise(""), F.regexp_replace(F.to_json(F.struct(F.get("l", c("m")).alias("x"))), r'^\{"x":|"?\}$', ""))
    cut = F.when(c("m") < F.size("l"), cut).otherwise(F.regexp_replace(head, r"\]\}$", ""))
    saved = docs.select("doc_id", jsons.salvage(F.when(c("doc_id") % 5 == 0, whole).otherwise(cut)).alias("s"))
    lines = F.from_json("s.json", "id long, lines array<string>")["lines"]
    return saved.select("doc_id", "s.whole", F.size(lines).cast("long").alias("n"), F.md5(F.array_join(lines, "\n")).alias("said"))
