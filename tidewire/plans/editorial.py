"""Scores, checks and decisions over whole texts; term lists suit the tables' invented prose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import classify, scoring
from tidewire.plans.registry import query
from tidewire.plans.stories import SQL, stories
from tidewire.session import read_table


def _has(column: str, terms) -> str:
    return "(" + " + ".join(f"contains({column}, '{t}')::INT" for t in terms) + ")"


REGIONAL, IMPACT, SERVICE = ("onthe", "reau", "schen"), ("whould", "tion", "eaux", "erst", "andin", "ment"), ("email", "http", "@")
STRONG, POOR, TIMELY = ("licens", "copyright"), ("worthless", "!!"), r"[0-9]{1,2}[h:][0-9]{0,2}"


@query(f"""WITH l AS (SELECT doc_id, lower(text) AS t FROM documents), b AS (SELECT *, CASE WHEN {_has('t', REGIONAL)} > 0 THEN 14 ELSE 0 END AS base FROM l),
s AS (SELECT doc_id, least(100, greatest(0, base + 10 * least({_has('t', IMPACT)}, CASE base WHEN 14 THEN 3 ELSE 4 END) + CASE WHEN {_has('t', SERVICE)} > 0 THEN 12 ELSE 0 END + CASE WHEN {_has('t', STRONG)} > 0 THEN 10 ELSE 0 END
  + CASE WHEN regexp_matches(t, '{TIMELY}') THEN 6 ELSE 0 END - CASE WHEN length(t) < 160 THEN 10 ELSE 0 END - CASE WHEN {_has('t', POOR)} > 0 THEN 20 ELSE 0 END))::INT AS relevance FROM b)
SELECT doc_id, relevance, CASE WHEN relevance >= 55 THEN 'headline' WHEN relevance >= 38 THEN 'high' WHEN relevance >= 22 THEN 'medium' ELSE 'low' END AS priority FROM s""")
def relevance_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance of each text and its band."""
    score = scoring.relevance(F.lower("text"), REGIONAL, IMPACT, SERVICE, STRONG, TIMELY, POOR).cast("int")
    rows = read_table(spark, sf_dir, "documents").select("doc_id", score.alias("relevance"))
    return rows.withColumn("priority", scoring.band(F.col("relevance"), (55, "headline"), (38, "high"), (22, "medium"), least="low"))


WANTED, WEAK = ("the ", "und ", "eaux", "para", "licens", "http"), ("worthless", "!!", "###")


@query(SQL + f"""SELECT doc_id, least(100, greatest(0, score // 2 + 12 * least({_has('low', WANTED)}, 5) - CASE WHEN {_has('low', WEAK)} > 0 THEN 20 ELSE 0 END + CASE WHEN channel = 'en' THEN 15 ELSE 0 END))::INT AS opportunity
FROM (SELECT s.*, lower(d.text) AS low FROM stories s JOIN documents d USING (doc_id))""")
def opportunity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opportunity from a base, strong and weak terms and a bonus of the origin."""
    rows = read_table(spark, sf_dir, "documents")
    base = F.floor(((F.col("doc_id") * 37) % 101) / 2)
    value = scoring.opportunity(F.lower("text"), base, WANTED, WEAK, F.when(F.col("lang") == "en", 15).otherwise(0))
    return rows.select("doc_id", value.cast("int").alias("opportunity"))


LEXICONS = {"rumour": (18, ("supposed", "worthless", "unlike")), "bias": (18, ("!!", "###", "***")), "sensation": (16, ("click", "$$$", "%%%", "&&&")), "sensitive": (10, ("token", "secret", "password", "key", "card", "@"))}
_RISK = ", ".join(f"least(100, {w} * {_has('low', terms)})::INT AS {name}" for name, (w, terms) in LEXICONS.items())


@query(f"""WITH s AS (SELECT doc_id, {_RISK} FROM (SELECT doc_id, lower(text) AS low FROM documents)), r AS (SELECT *, greatest({', '.join(LEXICONS)}) AS risk FROM s)
SELECT *, CASE WHEN risk >= 60 THEN 'high' WHEN risk >= 30 THEN 'medium' ELSE 'low' END AS band FROM r""")
def risk_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four lexicon scores, the greatest of them and its band."""
    return read_table(spark, sf_dir, "documents").select("doc_id", scoring.lexicon_risk(F.lower("text"), LEXICONS).alias("r")).select("doc_id", "r.*")


@query(r"""WITH c AS (SELECT doc_id, length(head) BETWEEN 30 AND 80 AS a, length(text) >= 1200 AS b, len(string_split(text, chr(10))) >= 4 AS c, regexp_matches(head, '[0-9]') AS d, regexp_matches(text, '[.!?]\s*$') AS e, NOT contains(text, '!!') AS f
  FROM (SELECT doc_id, text, split_part(text, chr(10), 1) AS head FROM documents))
SELECT doc_id, 25 * a::INT + 25 * b::INT + 20 * c::INT + 5 * d::INT + 15 * e::INT + 10 * f::INT AS score,
  array_to_string(list_filter([CASE WHEN NOT a THEN 'title' END, CASE WHEN NOT b THEN 'length' END, CASE WHEN NOT c THEN 'paragraphs' END, CASE WHEN NOT d THEN 'number' END, CASE WHEN NOT e THEN 'ending' END, CASE WHEN NOT f THEN 'shouting' END], lambda x: x IS NOT NULL), ' ') AS failed FROM c""")
def search_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted checks of a story for search engines, and those that fail."""
    head = F.substring_index("text", "\n", 1)
    found = scoring.checklist(
        ("title", 25, F.length(head).between(30, 80)), ("length", 25, F.length("text") >= 1200), ("paragraphs", 20, F.size(F.split("text", "\n")) >= 4),
        ("number", 5, head.rlike("[0-9]")), ("ending", 15, F.col("text").rlike(r"[.!?]\s*\z")), ("shouting", 10, ~F.contains("text", F.lit("!!"))),
    )
    rows = read_table(spark, sf_dir, "documents").select("doc_id", found.alias("c"))
    return rows.select("doc_id", F.col("c.score").alias("score"), F.array_join("c.failed", " ").alias("failed"))


@query(r"""WITH q AS (SELECT doc_id, length(text) AS n, coalesce(list_sum(list_transform(regexp_extract_all(text, '"[^"]*"|“[^”]*”'), lambda x: length(x))), 0) AS quoted FROM documents)
SELECT doc_id, quoted::BIGINT AS quoted, n > 0 AND quoted / greatest(n, 1) > 0.4 AS too_much FROM q""")
def quote_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted characters of each text, and whether they are over two fifths of it."""
    found = F.regexp_extract_all("text", F.lit('"[^"]*"|“[^”]*”'), F.lit(0))
    rows = read_table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"), F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("quoted"))
    return rows.select("doc_id", "quoted", (F.col("quoted") > F.col("n") * 0.4).alias("too_much"))


CRUTCHES = ("the", "und", "les", "para", "that", "worthless")


@query(f"""WITH l AS (SELECT doc_id, ' ' || regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', '  ', 'g') || ' ' AS low FROM documents)
SELECT doc_id, array_to_string(list_filter([{', '.join(f"'{w}'" for w in CRUTCHES)}], lambda w: length(low) - length(replace(low, ' ' || w || ' ', '')) >= 2 * (length(w) + 2)), ' ') AS words FROM l""")
def crutch_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed words that a text has twice or more."""
    return read_table(spark, sf_dir, "documents").select("doc_id", F.array_join(scoring.repeated_words(F.col("text"), CRUTCHES), " ").alias("words"))


BANNED = ("on the", "of the", "token", "worthless", "la", "einer der", "licensed under")
_BANNED = ", ".join(f"CASE WHEN contains({'low' if ' ' in t else 'spaced'}, '{t if ' ' in t else f' {t} '}') THEN '{t}' END" for t in sorted(BANNED, key=lambda t: (-len(t), t)))


@query(f"""WITH l AS (SELECT doc_id, lower(text) AS low, ' ' || regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' ' AS spaced FROM documents)
SELECT doc_id, array_to_string(list_filter([{_BANNED}], lambda x: x IS NOT NULL), ', ') AS found FROM l""")
def banned_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Banned phrases and words of each text, longest first."""
    return read_table(spark, sf_dir, "documents").select("doc_id", F.array_join(scoring.banned_terms(F.col("text"), BANNED), ", ").alias("found"))


@query(r"""WITH t AS (SELECT doc_id, list_distinct(list_filter(string_split(regexp_replace(regexp_replace(split_part(text, chr(10), 1), '[^\p{L}\p{N}.,]+', ' ', 'g'), '[.,]+( |$)', ' ', 'g'), ' '), lambda w: regexp_matches(w, '^([0-9][0-9.,]+|\p{Lu}\p{L}{3,})$'))) AS said,
  lower(substr(text, length(split_part(text, chr(10), 1)) + 1)) AS body FROM documents)
SELECT doc_id, len(list_filter(said, lambda w: NOT contains(body, lower(w)))) AS absent, len(said) AS said FROM t""")
def title_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many numbers and names a first line has, and how many of them the rest lacks."""
    head = F.substring_index("text", "\n", 1)
    body = F.expr("substring(text, length(substring_index(text, '\n', 1)) + 1)")
    said = scoring.claims(head)
    return read_table(spark, sf_dir, "documents").select("doc_id", F.size(scoring.absent_from(said, body)).cast("long").alias("absent"), F.size(said).cast("long").alias("said"))


@query("""SELECT doc_id, CASE WHEN toxic = 1 THEN 'block' WHEN quality = 1 AND n_chars >= 500 AND score >= 90 THEN 'publish' WHEN score >= 35 THEN 'draft' ELSE 'block' END AS destination
FROM (SELECT doc_id, n_chars, (doc_id * 37) % 101 AS score FROM documents) LEFT JOIN labels USING (doc_id)""")
def destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block, draft or publish from faults, conditions and the score."""
    rows = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars", ((F.col("doc_id") * 37) % 101).alias("score"))
    rows = rows.join(read_table(spark, sf_dir, "labels"), "doc_id", "left")
    where = scoring.destination(F.col("toxic") == 1, (F.col("quality") == 1) & (F.col("n_chars") >= 500), F.col("score"))
    return rows.select("doc_id", where.alias("destination"))


@query(r"""WITH p AS (SELECT doc_id, text, len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) >= 60))) AS useful FROM documents)
SELECT doc_id, useful, CASE WHEN length(trim(text)) < 40 THEN 'empty' WHEN contains(lower(text), 'worthless') THEN 'promotion' WHEN useful >= 4 THEN 'accepted' WHEN useful >= 3 AND length(split_part(text, chr(10), 1)) >= 20 THEN 'accepted' WHEN length(text) >= 500 AND useful >= 2 THEN 'accepted' ELSE 'thin' END AS verdict FROM p""")
def editorial_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blockers first, then enough useful paragraphs (distinct lines of 60 characters or more)."""
    useful = F.size(F.array_distinct(F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) >= 60))).cast("long")
    rows = read_table(spark, sf_dir, "documents").select("doc_id", "text", useful.alias("useful"))
    n = F.col("useful")
    enough = (n >= 4) | ((n >= 3) & (F.length(F.substring_index("text", "\n", 1)) >= 20)) | ((F.length("text") >= 500) & (n >= 2))
    verdict = classify.gate((F.length(F.trim("text")) < 40, "empty"), (F.contains(F.lower("text"), F.lit("worthless")), "promotion"), (~enough, "thin"), passed="accepted")
    return rows.select("doc_id", "useful", verdict.alias("verdict"))


@query(r"""SELECT sufficiency, count(*) AS n, sum(raw)::BIGINT AS raw FROM (SELECT length(text) AS raw, CASE WHEN c = 0 THEN 'empty' WHEN c < 100 AND length(text) > 500 THEN 'too_short' WHEN c < 600 THEN 'short_but_usable' ELSE 'sufficient' END AS sufficiency
FROM (SELECT text, length(trim(regexp_replace(regexp_replace(text, 'https?://\S+|[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g'))) AS c FROM documents)) GROUP BY 1""")
def source_sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts by how much is left of them once addresses and marks are gone."""
    clean = F.length(F.trim(F.regexp_replace(F.regexp_replace("text", r"https?://\S+|[^\p{L}\p{N}\s]", ""), r"\s+", " ")))
    rows = read_table(spark, sf_dir, "documents").select(F.length("text").alias("raw"), clean.alias("c"))
    kind = classify.gate((F.col("c") == 0, "empty"), ((F.col("c") < 100) & (F.col("raw") > 500), "too_short"), (F.col("c") < 600, "short_but_usable"), passed="sufficient")
    return rows.groupBy(kind.alias("sufficiency")).agg(F.count("*").alias("n"), F.sum("raw").alias("raw"))


ALIASES = (("northern office", ("onthe", "theon"), None), ("language desk", ("northern office",), "tion"), ("press room", ("eaux", "reau"), "ment"))


@query(SQL + """, a AS (SELECT doc_id, lower(title) AS t FROM stories), b AS (SELECT doc_id, CASE WHEN contains(t, 'onthe') OR contains(t, 'theon') THEN t || ' northern office' ELSE t END AS t FROM a),
c AS (SELECT doc_id, CASE WHEN contains(t, 'northern office') AND contains(t, 'tion') THEN t || ' language desk' ELSE t END AS t FROM b)
SELECT doc_id, CASE WHEN (contains(t, 'eaux') OR contains(t, 'reau')) AND contains(t, 'ment') THEN t || ' press room' ELSE t END AS expanded FROM c""")
def alias_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with canonical names appended in order; an appended name can start the next alias."""
    return stories(spark, sf_dir).select("doc_id", scoring.expand_aliases(F.lower("title"), ALIASES).alias("expanded"))


WATCH, WATCH_TERMS = (("the ", "and ", "of "), ("le ", "eaux", "que "), ("und ", "sch", "der ")), ("tion", "ment", "para", "los ", "ing ", "est ")


@query(f"""WITH h AS (SELECT doc_id, list_filter([{', '.join(f"'{t}'" for g in WATCH for t in g)}], lambda t: contains(low, t)) AS a, list_filter([{', '.join(f"'{t}'" for t in WATCH_TERMS)}], lambda t: contains(low, t)) AS b FROM (SELECT doc_id, lower(text) AS low FROM documents))
SELECT doc_id, array_to_string(list_concat(a[1:4], b)[1:7], '|') AS names FROM h""")
def watch_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watched names of each text, four from the groups and seven in all at most."""
    return read_table(spark, sf_dir, "documents").select("doc_id", F.array_join(scoring.watched(F.lower("text"), WATCH, WATCH_TERMS, 4, 7), "|").alias("names"))


FLOWS = (("core", ("licens", "copyright")), ("noise", ("worthless", "!!", "###")), ("service", ("@", "http", "+")), ("crime", ("token", "secret")), ("sport", ("tion", "ción")), ("people", ("sch", "eaux")))


@query("SELECT flow, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN {_has('low', t)} > 0 THEN '{n}'" for n, t in FLOWS) + " ELSE 'core' END AS flow FROM (SELECT lower(text) AS low FROM documents)) GROUP BY flow")
def audience_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts by the first flow whose terms they hold: core, noise, then reach groups; core by default."""
    low = F.lower("text")
    flow = classify.gate(*[(scoring.any_of(low, terms), name) for name, terms in FLOWS], passed="core")
    return read_table(spark, sf_dir, "documents").groupBy(flow.alias("flow")).agg(F.count("*").alias("n"))


@query(r"""WITH w AS (SELECT doc_id, unnest(list_filter(string_split(lower(regexp_replace(text, '[^\p{L}]+', ' ', 'g')), ' '), lambda x: length(x) >= 4)) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(*) AS n FROM documents),
s AS (SELECT doc_id, term, round(tf * ln((1 + n.n) / (1 + df)), 6) AS weight FROM tf JOIN df USING (term), n), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term)::INT AS rank FROM s)
SELECT doc_id, term, weight, rank FROM r WHERE rank <= 3""")
def key_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three terms of greatest TF-IDF weight of each text; counts cover all texts."""
    return classify.top_terms(read_table(spark, sf_dir, "documents"), "doc_id", "text", 3)
