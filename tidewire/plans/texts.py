"""Normal forms, keys, scores and audits of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import text
from tidewire.operators import classify
from tidewire.plans.registry import query
from tidewire.plans.stories import FOLD, NORMAL, SQL, stories
from tidewire.session import read_table


@query(SQL + f"SELECT doc_id, {FOLD.format('title')} AS folded, {NORMAL.format('title')} AS normal FROM stories")
def title_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stories(spark, sf_dir).select("doc_id", text.fold(F.col("title")).alias("folded"), text.normal_title(F.col("title")).alias("normal"))


@query(f"SELECT doc_id, substr(sha256({FOLD.format('text')}), 1, 16) AS hash FROM documents")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of each whole folded text."""
    return read_table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text")).alias("hash"))


@query(SQL + "SELECT doc_id, substr(md5(link || title), 1, 16) AS uid FROM stories")
def story_uids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stories(spark, sf_dir).select("doc_id", text.row_uid(F.col("link"), F.col("title")).alias("uid"))


_WORDS = "trim(regexp_replace(" + FOLD.format("title") + ", '[^a-z0-9]+', ' ', 'g'))"


@query(SQL + f", s AS (SELECT doc_id, replace({_WORDS}, ' ', '-') AS full_slug FROM stories) SELECT doc_id, CASE WHEN length(full_slug) <= 60 THEN full_slug ELSE regexp_replace(substr(full_slug, 1, 61), '-[^-]*$', '') END AS slug FROM s")
def title_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stories(spark, sf_dir).select("doc_id", text.slug(F.col("title")).alias("slug"))


@query(r"""SELECT doc_id, len(s) AS n_sentences, coalesce(list_sum(list_transform(s, lambda x: length(x))), 0)::BIGINT AS n_chars
FROM (SELECT doc_id, list_distinct(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) >= 35)) AS s FROM documents)""")
def sentence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sentences of at least 35 characters."""
    rows = read_table(spark, sf_dir, "documents").select("doc_id", text.sentences(F.col("text")).alias("s"))
    size = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return rows.select("doc_id", F.size("s").cast("long").alias("n_sentences"), size.alias("n_chars"))


@query(r"SELECT doc_id, array_to_string(n, ' ') AS numbers FROM (SELECT doc_id, regexp_extract_all(text, '\b\d+[\d.,]*\b') AS n FROM documents) WHERE len(n) > 0")
def number_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents").select("doc_id", text.number_tokens(F.col("text")).alias("n"))
    return rows.where(F.size("n") > 0).select("doc_id", F.array_join("n", " ").alias("numbers"))


WEIGHTS = {"the ": 9, "licen": 30, "token": 25, "que ": 12, "und ": 12, "para ": 14, "http": 40}


@query("SELECT doc_id, least(60, " + " + ".join(f"CASE WHEN contains(lower(text), '{t}') THEN {w} ELSE 0 END" for t, w in WEIGHTS.items()) + ") AS score FROM documents")
def term_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted terms with a cap."""
    return read_table(spark, sf_dir, "documents").select("doc_id", classify.term_score(F.lower("text"), WEIGHTS, 60).alias("score"))


CHANNELS = {"english": ("the ", " and ", " of ", "tion"), "french": (" le ", " la ", "eaux", " des "), "german": (" und ", " der ", "sch", " die "), "spanish": (" el ", " para ", "ción", " los ")}
_HITS = ", ".join(f"len(list_filter([{', '.join(repr(t) for t in terms)}], lambda t: contains(low, t))) AS {name}" for name, terms in CHANNELS.items())
_MOST = f"greatest({', '.join(CHANNELS)})"


@query(f"""WITH c AS (SELECT doc_id, {_HITS} FROM (SELECT doc_id, lower(text) AS low FROM documents))
SELECT doc_id, CASE WHEN {_MOST} = 0 THEN 'other' {' '.join(f"WHEN {n} = {_MOST} THEN '{n}'" for n in CHANNELS)} END AS channel, CASE WHEN {_MOST} >= 4 THEN 'high' WHEN {_MOST} >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM c""")
def channel_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel with most dictionary terms, the first on ties, and its confidence."""
    best = classify.by_dictionary(F.lower("text"), CHANNELS, "other")
    rows = read_table(spark, sf_dir, "documents").select("doc_id", best.alias("b"))
    return rows.select("doc_id", F.col("b.name").alias("channel"), F.when(F.col("b.n") >= 4, "high").when(F.col("b.n") >= 2, "medium").otherwise("low").alias("confidence"))


@query(r"""WITH p AS (SELECT doc_id, (CASE WHEN length(text) < 500 THEN 20 ELSE 0 END + CASE WHEN length(split_part(text, chr(10), 1)) > 80 THEN 15 ELSE 0 END + CASE WHEN contains(text, '—') THEN 4 ELSE 0 END
  + 5 * len(regexp_extract_all(text, '!!'))) AS p FROM documents)
SELECT doc_id, least(100, greatest(0, 100 - p))::INT AS quality, ((100 - least(100, greatest(0, 100 - p))) // 2)::INT AS risk FROM p""")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 less penalties, clamped, and the risk that follows from it."""
    off = F.when(F.length("text") < 500, 20).otherwise(0) + F.when(F.length(F.substring_index("text", "\n", 1)) > 80, 15).otherwise(0) + F.when(F.contains("text", F.lit("—")), 4).otherwise(0)
    off = off + 5 * F.regexp_count("text", F.lit("!!"))
    quality = classify.clamp(100 - off, 0, 100)
    return read_table(spark, sf_dir, "documents").select("doc_id", quality.cast("int").alias("quality"), F.floor((100 - quality) / 2).cast("int").alias("risk"))


@query(r"""WITH s AS (SELECT doc_id, {t} AS facts, lower(text) AS low FROM documents)
SELECT doc_id, len(facts) AS n_facts, round(CASE WHEN len(facts) = 0 THEN 1.0 ELSE len(list_filter(facts, lambda f: contains(low, f))) / len(facts) END, 4) AS coverage
FROM (SELECT doc_id, list_distinct(list_filter(string_split(lower(split_part(text, chr(10), 1)), ' '), lambda w: length(w) > 3)) AS facts, substr(lower(text), 200) AS low FROM documents)""".replace("WITH s AS (SELECT doc_id, {t} AS facts, lower(text) AS low FROM documents)\n", ""))
def fact_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the first line's long words that the rest of a text has."""
    facts = F.array_distinct(F.filter(F.split(F.lower(F.substring_index("text", "\n", 1)), " "), lambda w: F.length(w) > 3))
    rows = read_table(spark, sf_dir, "documents").select("doc_id", facts.alias("facts"), F.expr("substring(lower(text), 200)").alias("low"))
    there = F.size(F.filter("facts", lambda f: F.contains("low", f)))
    return rows.select("doc_id", F.size("facts").cast("long").alias("n_facts"), F.round(F.when(F.size("facts") == 0, 1.0).otherwise(there / F.size("facts")), 4).alias("coverage"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
k AS (SELECT *, substr(regexp_replace(lower(line), '[^\p{L}\p{N}]', '', 'g'), 1, 180) AS k FROM l WHERE length(line) >= 25),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY i) AS r FROM k) SELECT doc_id, count(*) AS lines, count(*) FILTER (r > 1) AS repeated FROM f GROUP BY doc_id""")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 25 characters or more within each text, and those that repeat an earlier key."""
    keys = F.transform(F.filter(F.split("text", "\n"), lambda x: F.length(x) >= 25), lambda x: text.title_key(x))
    rows = read_table(spark, sf_dir, "documents").select("doc_id", keys.alias("k")).where(F.size("k") > 0)
    return rows.select("doc_id", F.size("k").cast("long").alias("lines"), (F.size("k") - F.size(F.array_distinct("k"))).cast("long").alias("repeated"))
