"""Keys, cuts and counts of articles and findings, and the bounded lists of a review desk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import text
from tidewire.plans.registry import query
from tidewire.plans.stories import SQL, TOKENS, stories
from tidewire.session import read_table

#: Words that a cut title does not end with.
WEAK = ("the", "of", "and", "de", "la", "le", "und", "der", "die", "el", "para")
#: What a closing line is searched for.
CLOSING = ("licen", "token", "that", "que ", "und ")


@query(SQL + r"SELECT doc_id, substr(regexp_replace(lower(title), '[^\p{L}\p{N}]', '', 'g'), 1, 180) AS key FROM stories")
def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stories(spark, sf_dir).select("doc_id", text.title_key(F.col("title")).alias("key"))


@query(f"SELECT doc_id, array_to_string(({TOKENS.format('text')})[1:18], ' ') AS signature FROM documents")
def token_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 18 distinct words of each whole text in alphabetical order."""
    rows = read_table(spark, sf_dir, "documents")
    return rows.select("doc_id", F.array_join(F.slice(text.tokens(F.col("text")), 1, 18), " ").alias("signature"))


_WEAK = "|".join(WEAK)
_CUT = r"regexp_replace(regexp_replace(substr(title, 1, 51), '\s+\S*$', ''), '[\s,;:.-]+$', '')"


@query(SQL + rf"SELECT doc_id, CASE WHEN length(title) <= 50 THEN title ELSE regexp_replace(regexp_replace({_CUT}, '\s+(?i:{_WEAK})$', ''), '[\s,;:.-]+$', '') END AS safe FROM stories")
def safe_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of more than 50 characters are cut at a space, and end with no mark and no weak word."""
    cut = F.substring("title", 1, 51)
    for pattern in (r"\s+\S*$", r"[\s,;:.-]+$", rf"\s+(?i:{_WEAK})$", r"[\s,;:.-]+$"):
        cut = F.regexp_replace(cut, pattern, "")
    return stories(spark, sf_dir).select("doc_id", F.when(F.length("title") <= 50, F.col("title")).otherwise(cut).alias("safe"))


@query("""WITH l AS (SELECT doc_id, list_distinct(string_split(text, chr(10))) AS lines FROM documents)
SELECT doc_id, len(list_filter(lines, lambda x: length(x) >= 60)) AS paragraphs,
  coalesce(list_sum(list_transform(list_filter(lines, lambda x: length(x) >= 20), lambda x: length(x))), 0)::BIGINT AS chars FROM l""")
def useful_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct lines of at least 60 characters, and the characters of those of at least 20."""
    rows = read_table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.split("text", "\n")).alias("lines"))
    chars = F.aggregate(F.filter("lines", lambda x: F.length(x) >= 20), F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return rows.select("doc_id", F.size(F.filter("lines", lambda x: F.length(x) >= 60)).cast("long").alias("paragraphs"), chars.alias("chars"))


@query(f"""SELECT doc_id, array_to_string(list_filter([{', '.join(repr(t) for t in CLOSING)}], lambda t: contains(lower(string_split(text, chr(10))[-1]), t)), ',') AS found
FROM documents WHERE len(list_filter([{', '.join(repr(t) for t in CLOSING)}], lambda t: contains(lower(string_split(text, chr(10))[-1]), t))) > 0""")
def closing_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed phrases in the last line of each text."""
    rows = read_table(spark, sf_dir, "documents").select("doc_id", F.lower(F.substring_index("text", "\n", -1)).alias("last"))
    found = rows.select("doc_id", text.hits(F.col("last"), CLOSING).alias("found"))
    return found.where(F.size("found") > 0).select("doc_id", F.array_join("found", ",").alias("found"))


@query("SELECT conv_id, turn, substr(sha256(role || '|' || text), 1, 20) AS key FROM conversations")
def finding_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.substring(F.sha2(F.concat("role", F.lit("|"), "text"), 256), 1, 20)
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", key.alias("key"))


@query("SELECT event_id, strftime(ts, '%d/%m/%Y %H:%M') AS shown, strftime(ts, '%Y-%m-%d %H:%M:%S') AS sorted FROM events")
def date_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as they are shown and as they are sorted."""
    return read_table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "dd/MM/yyyy HH:mm").alias("shown"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("sorted"))


@query("SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1, 2")
def daily_publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publications of each source and day."""
    rows = read_table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return rows.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type NOT IN ('error', 'purchase') ORDER BY ts DESC, event_id DESC LIMIT 500")
def review_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest 500 rows that wait for a review: a list of bounded length."""
    rows = read_table(spark, sf_dir, "events").where("event_type not in ('error', 'purchase')")
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(500).select("event_id", "user_id", "event_type")
