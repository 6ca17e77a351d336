"""Documents against a table of phrases: the runs of words of benchmark items, with contexts and exceptions, weights and caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import terms, types
from tidewire.plans.registry import query
from tidewire.session import read_table

#: Parts of the score: cap and mode. Terms of one word are ambiguous: they count only with another word of their item near in kind.
PARTS = (("word", 12, "sum"), ("pair", 20, "sum"), ("triple", 30, "sum"), ("place", 15, "max"), ("urgent", 20, "max"))
FORM = r"trim(regexp_replace(strip_accents(lower(coalesce({0}, ''))), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def term_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, pairs and triples of benchmark items as terms: a word of five letters or more counts with the word behind it in the item as context;
    the first pair of an item is its place; the first word is urgent unless the text also holds the last."""
    items = read_table(spark, sf_dir, "benchmark").select("item_id", F.split(terms.word_form(F.col("text")), " ").alias("w")).where(F.size("w") >= 4)
    at = items.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 3)).alias("i"))
    run = lambda n: F.array_join(F.slice("w", F.col("i"), n), " ")
    none = F.lit(None).cast("array<string>")
    word = at.where(F.length(F.get("w", F.col("i") - 1)) >= 5).select(run(1).alias("term"), F.lit("word").alias("part"), F.lit(1).alias("weight"), F.array(F.get("w", F.col("i"))).alias("context"), none.alias("unless"))
    pair = at.select(run(2), F.lit("pair"), F.lit(2), none, none)
    triple = at.select(run(3), F.lit("triple"), F.lit(5), none, none)
    first = at.where("i = 1")
    place = first.select(run(2), F.lit("place"), (F.col("item_id") % 3 * 5 + 5).cast("int"), none, none)
    urgent = first.select(run(1), F.lit("urgent"), F.lit(20), none, F.array(F.element_at("w", -1)))
    return word.union(pair).union(triple).union(place).union(urgent)


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = term_table(spark, sf_dir)
    # of equal terms, every context will do: their rows are joined into one
    merged = table.groupBy("part", "term").agg(F.max("weight").alias("weight"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("context", F.array().cast("array<string>"))))).alias("context"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("unless", F.array().cast("array<string>"))))).alias("unless"))
    return terms.match_terms(read_table(spark, sf_dir, "documents"), merged, "doc_id", "text")


HITS = f"""WITH w AS (SELECT item_id, string_split({FORM.format("text")}, ' ') AS w FROM benchmark), i AS (SELECT item_id, w, unnest(range(1, len(w) - 2)) AS i FROM w WHERE len(w) >= 4),
terms AS (SELECT w[i] AS term, 'word' AS part, 1 AS weight, w[i + 1] AS context, NULL::VARCHAR AS unless FROM i WHERE length(w[i]) >= 5
  UNION ALL SELECT w[i] || ' ' || w[i + 1], 'pair', 2, NULL, NULL FROM i UNION ALL SELECT w[i] || ' ' || w[i + 1] || ' ' || w[i + 2], 'triple', 5, NULL, NULL FROM i
  UNION ALL SELECT w[1] || ' ' || w[2], 'place', item_id % 3 * 5 + 5, NULL, NULL FROM i WHERE i = 1 UNION ALL SELECT w[1], 'urgent', 20, NULL, w[-1] FROM i WHERE i = 1),
d AS (SELECT doc_id, string_split({FORM.format("text")}, ' ') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS term FROM d),
m AS (SELECT doc_id, t.* FROM (SELECT DISTINCT * FROM terms) t JOIN g USING (term)),
hits AS (SELECT doc_id, part, term, max(weight) AS weight FROM m
  WHERE (context IS NULL OR EXISTS (SELECT 1 FROM g WHERE g.doc_id = m.doc_id AND g.term = m.context))
    AND NOT EXISTS (SELECT 1 FROM terms u JOIN g ON g.term = u.unless WHERE u.part = m.part AND u.term = m.term AND g.doc_id = m.doc_id) GROUP BY ALL)"""


@query(f"""{HITS} SELECT doc_id, part, count(*) AS n, sum(weight)::BIGINT AS weight, md5(string_agg(term, ',' ORDER BY term)) AS terms FROM hits GROUP BY doc_id, part""")
def term_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of the table that each whole text holds, by part."""
    rows = _hits(spark, sf_dir).groupBy("doc_id", "part").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.md5(F.array_join(F.array_sort(F.collect_list("term")), ",")).alias("terms"))
    return rows.select("doc_id", "part", "n", "weight", "terms")


@query(f"""{HITS}, parts(part, cap, mode) AS (VALUES {", ".join(map(str, PARTS))}),
s AS (SELECT doc_id, part, count(*) AS hits, least(CASE WHEN mode = 'max' THEN max(weight) ELSE sum(weight) END, cap)::BIGINT AS points FROM hits JOIN parts USING (part) GROUP BY doc_id, part, cap, mode)
SELECT doc_id, {", ".join(f"coalesce(sum(points) FILTER (part = '{p}'), 0)::BIGINT AS {p}" for p, _, _ in PARTS)}, greatest(0, least(100, 20 + sum(points)))::BIGINT AS score,
  concat_ws(',', {", ".join(f"max(CASE WHEN part = '{p}' AND hits >= 2 THEN part END)" for p, _, _ in PARTS)}) AS reasons FROM s GROUP BY doc_id""")
def composite_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part of the score with its cap, their sum within 0 and 100, and the parts that two terms or more speak for."""
    scored = terms.part_scores(_hits(spark, sf_dir), spark.createDataFrame(PARTS, "part string, cap int, mode string"), "doc_id")
    names = [p for p, _, _ in PARTS]
    rows = terms.composite_score(scored, names, "doc_id", base=20)
    return rows.select("doc_id", *[F.col(p).cast("long").alias(p) for p in names], F.col("score").cast("long").alias("score"), F.array_join("reasons", ",").alias("reasons"))


#: Clues of types by whole words, and the rules of channels, which are the languages here.
CLUES = {"preview": ("the", "que", "und"), "result": ("of", "para", "mit"), "court": ("to be", "the of", "de la"), "service": ("in", "of the", "la de", "der", "et"), "report": ("an", "is", "des", "los")}
RULES = types.TypeRules(("court", "service", "report"), {"es": ("result", "preview", "plain")}, {"de": "editorial"}, {"fr": "culture"})
_COUNT = {t: " + ".join(f"contains(t, ' {w} ')::INT" for w in words) for t, words in CLUES.items()}


@query(f"""WITH d AS (SELECT doc_id, lang, ' ' || {FORM.format("text")} || ' ' AS t FROM documents), n AS (SELECT doc_id, lang, {", ".join(f"{c} AS {t}" for t, c in _COUNT.items())} FROM d)
SELECT doc_id, CASE WHEN lang = 'es' THEN CASE WHEN result > 0 THEN 'result' WHEN preview > 0 THEN 'preview' ELSE 'plain' END WHEN lang = 'de' THEN 'editorial'
  WHEN court > 0 AND court >= service AND court >= report THEN 'court' WHEN service > 0 AND service >= report THEN 'service' WHEN report > 0 THEN 'report' WHEN lang = 'fr' THEN 'culture' ELSE 'hard_news' END AS type FROM n""")
def article_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type of each document: by its channel's own rule, by most clues in its whole text, or by what its channel stands for."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    table = spark.createDataFrame([(w, t, 1) for t, words in CLUES.items() for w in words], "term string, part string, weight int")
    return types.article_types(docs, terms.match_terms(docs, table, "doc_id", "text"), RULES, "doc_id", "lang").select("doc_id", "type")
