"""Text cleaning, similarity of articles, secondary scores and source lists, over documents, pages and stories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import urls
from tidewire.functions.text import fold, normal_title, tokens
from tidewire.operators import gates, similar, terms
from tidewire.operators.classify import clamp
from tidewire.plans.registry import query
from tidewire.plans.stories import FOLD, LINK_KEY, NORMAL, SQL, TOKENS, stories
from tidewire.session import read_table, saved

SPACES = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


@query(f"""WITH t AS (SELECT doc_id, {SPACES.format("text")} AS s FROM documents), h AS (SELECT doc_id, s, substr(s, 1, 160) AS head, regexp_extract(substr(s, 1, 160), '^(.*[.;])', 1) AS stop, regexp_extract(substr(s, 1, 160), '^(.*) ', 1) AS word FROM t)
SELECT doc_id, CASE WHEN length(s) <= 160 THEN s WHEN length(word) > 0 THEN word ELSE head END AS truncated,
  CASE WHEN length(s) <= 160 THEN s WHEN length(stop) >= 104 THEN stop WHEN length(word) >= 88 THEN word ELSE head END AS sentence FROM h""")
def safe_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text cut to 160 characters at a word, and at the end of a sentence where there is one late enough."""
    said = F.trim(F.regexp_replace("text", r"\s+", " "))
    head = F.substring(said, 1, 160)
    stop, word = F.regexp_extract(head, "^(.*[.;])", 1), F.regexp_extract(head, "^(.*) ", 1)
    short = F.length(said) <= 160
    return read_table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(short, said).when(F.length(word) > 0, word).otherwise(head).alias("truncated"),
        F.when(short, said).when(F.length(stop) >= 104, stop).when(F.length(word) >= 88, word).otherwise(head).alias("sentence"),
    )


@query("""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS s FROM pages),
u AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(s, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS s FROM t)
SELECT page_id, md5(s) AS said, length(regexp_replace(s, 'https?://\\S+', '', 'g')) AS useful FROM u""".replace("\\\\", "\\"))
def html_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's text without tags and with entities read, and its length without addresses."""
    said = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        said = F.replace(said, F.lit(entity), F.lit(char))
    own = read_table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_replace(said, r"\s+", " ")).alias("s"))
    return own.select("page_id", F.md5("s").alias("said"), F.length(F.regexp_replace("s", r"https?://\S+", "")).alias("useful"))


PARAGRAPHS = "list_filter(list_transform(regexp_split_to_array(coalesce({0}, ''), '\\n'), lambda p: trim(regexp_replace(p, '\\s+', ' ', 'g'))), lambda p: length(p) > 40)"


def paragraphs(text):
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    return F.filter(parts, lambda p: F.length(p) > 40)


@query(f"""WITH p AS (SELECT doc_id, text, {PARAGRAPHS.format("text")} AS p FROM documents), k AS (SELECT *, list_transform(p, lambda x: lower(substr(x, 1, 180))) AS k FROM p)
SELECT doc_id, len(p) AS n, len(list_distinct(k)) < len(k) AS repeats, len(list_filter(p, lambda x: length(x) >= 260)) AS long FROM k""")
def paragraph_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of a text, whether two begin alike, and how many are long enough to be cut again."""
    own = read_table(spark, sf_dir, "documents").select("doc_id", paragraphs(F.col("text")).alias("p"))
    keys = F.transform("p", lambda x: F.lower(F.substring(x, 1, 180)))
    return own.select("doc_id", F.size("p").alias("n"), (F.size(F.array_distinct(keys)) < F.size(keys)).alias("repeats"), F.size(F.filter("p", lambda x: F.length(x) >= 260)).alias("long"))


@query(f"""WITH w AS (SELECT doc_id, list_transform({PARAGRAPHS.format("text")}, lambda p: list_filter({TOKENS.format("p")}, lambda x: length(x) >= 4)) AS w FROM documents),
g AS (SELECT doc_id, w[i] AS a, w[i + 1] AS b FROM w, LATERAL (SELECT unnest(range(1, len(w))) AS i)),
s AS (SELECT doc_id, len(list_intersect(a, b)) AS shared, least(len(a), len(b)) AS small FROM g)
SELECT doc_id, count(*) FILTER (shared >= 8 AND shared >= 0.65 * small) AS overlapping, count(*) AS n FROM s GROUP BY doc_id""")
def paragraph_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring paragraphs that say much the same: eight longer words and 0.65 of the smaller set in common."""
    words = F.transform(paragraphs(F.col("text")), lambda p: F.filter(tokens(p), lambda x: F.length(x) >= 4))
    own = read_table(spark, sf_dir, "documents").select("doc_id", words.alias("w")).where(F.size("w") > 1)
    both = F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.struct(F.size(F.array_intersect(F.get("w", i), F.get("w", i + 1))).alias("both"), F.least(F.size(F.get("w", i)), F.size(F.get("w", i + 1))).alias("least")))
    near = F.filter(both, lambda s: (s["both"] >= 8) & (s["both"] >= 0.65 * s["least"]))
    return own.select("doc_id", F.size(near).cast("long").alias("overlapping"), (F.size("w") - 1).cast("long").alias("n"))


@query("""SELECT doc_id, trim(regexp_replace(strip_accents(lower(t)), '[^a-z0-9]+', ' ', 'g')) AS alnum, translate(lower(t), 'áàãâéêíóõôúç', 'aaaaeeiooouc') AS few, regexp_replace(strip_accents(t), '[^\\x00-\\x7F]', '', 'g') AS ascii FROM (SELECT doc_id, substr(split_part(text, chr(10), 1), 1, 80) AS t FROM documents)""".replace("\\\\", "\\"))
def accent_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three folds of a title: letters and digits without accents, twelve accented letters only, and ASCII only.

    Spark has no normal form among its functions, so the letters of the Latin supplement are mapped by a
    table made from Unicode's own decompositions."""
    import unicodedata

    # a rule, not a list: every letter of two Latin blocks that is one ASCII letter and an accent
    pairs = [(c, d[0]) for c in map(chr, range(0xC0, 0x180)) if len(d := unicodedata.normalize("NFD", c)) == 2 and d[0].isascii()]
    plain = lambda c: F.regexp_replace(F.translate(c, "".join(a for a, _ in pairs), "".join(b for _, b in pairs)), r"\p{Mn}+", "")
    own = read_table(spark, sf_dir, "documents").select("doc_id", F.substring(F.substring_index("text", "\n", 1), 1, 80).alias("t"))
    return own.select(
        "doc_id",
        F.trim(F.regexp_replace(plain(F.lower("t")), "[^a-z0-9]+", " ")).alias("alnum"),
        F.translate(F.lower("t"), "áàãâéêíóõôúç", "aaaaeeiooouc").alias("few"),
        F.regexp_replace(plain(F.col("t")), r"[^\x00-\x7F]", "").alias("ascii"),
    )


@query(SQL + """SELECT doc_id, sha1(link || '|' || lower(coalesce(title, ''))) AS uid, 'src_' || substr(sha1(link), 1, 24) AS prefixed, lower(trim(channel)) IN ('1', 'true', 'sim', 'yes', 'on', 'en') AS flag,
  strftime(captured, '%Y-%m-%d %H:%M:%S') AS sort_date, CASE WHEN length(link) <= 12 THEN '***' ELSE substr(link, 1, 6) || '***' || substr(link, length(link) - 3) END AS masked FROM stories""")
def row_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests that name a row, a flag read from words, a date that sorts as text, and a masked secret."""
    link = F.col("link")
    return stories(spark, sf_dir).select(
        "doc_id",
        F.sha1(F.concat(link, F.lit("|"), F.lower(F.coalesce("title", F.lit(""))))).alias("uid"),
        F.concat(F.lit("src_"), F.substring(F.sha1(link), 1, 24)).alias("prefixed"),
        F.lower(F.trim("channel")).isin("1", "true", "sim", "yes", "on", "en").alias("flag"),
        F.date_format("captured", "yyyy-MM-dd HH:mm:ss").alias("sort_date"),
        F.when(F.length(link) <= 12, "***").otherwise(F.concat(F.substring(link, 1, 6), F.lit("***"), F.right(link, F.lit(4)))).alias("masked"),
    )


@query(SQL + f""", t AS (SELECT doc_id, {LINK_KEY.format("link")} AS key, {NORMAL.format("title")} AS said, {TOKENS.format("title")} AS w, captured < TIMESTAMP '2024-01-15' AS past FROM stories),
g AS (SELECT key, count(*) AS n FROM t WHERE NOT past GROUP BY key),
k AS (SELECT w, count(*) FILTER (past) AS past, count(*) FILTER (NOT past) AS now FROM t WHERE len(w) > 0 GROUP BY w),
p AS (SELECT a.w, max(len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w))) FILTER (b.past > 0) AS memory, max(len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w))) FILTER (b.now > (a.w = b.w)::INT) AS batch
  FROM k a JOIN k b ON len(b.w) >= 0.72 * len(a.w) AND len(a.w) >= 0.72 * len(b.w) AND len(list_intersect(a.w, b.w)) >= 0.72 * len(list_distinct(a.w || b.w)) WHERE a.now > 0 GROUP BY a.w)
SELECT doc_id, n > 1 AS same_link, round(coalesce(memory, 0), 6)::DOUBLE AS memory, round(coalesce(batch, 0), 6)::DOUBLE AS batch, said <> '' AND said IN (SELECT said FROM t WHERE past) AS guarded, n > 1 OR coalesce(memory, 0) >= 0.72 OR coalesce(batch, 0) >= 0.72 AS duplicate
FROM t JOIN g USING (key) LEFT JOIN p USING (w) WHERE NOT past""")
def semantic_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows that repeat a link of the batch, a title of the memory (all rows captured before the 15th), or one of the batch, at 0.72 of their words or more; both of a pair are flagged."""
    past = F.col("captured") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    rows = stories(spark, sf_dir).select("doc_id", urls.key(F.col("link")).alias("link"), normal_title(F.col("title")).alias("said"), tokens(F.col("title")).alias("w"), past.alias("past"))
    rows = rows.withColumn("key", F.md5(F.to_json("w")))
    new = rows.where("not past")
    classes = rows.where(F.size("w") > 0).groupBy("key").agg(F.first("w").alias("words"), F.count_if("past").alias("n_past"), F.count_if(~F.col("past")).alias("n_now"))
    classes = saved(classes)
    pairs = similar.similar_classes(classes.select("key", "words"), 0.72, longs=similar.SHORT, rounds=1)
    both = pairs.select("a", "b", "similarity").union(pairs.select("b", "a", "similarity"))
    own = classes.select(F.col("key").alias("a"), F.col("key").alias("b"), F.lit(1.0).alias("similarity"))
    met = both.union(own).join(classes.select(F.col("key").alias("b"), "n_past", "n_now"), "b")
    others = F.col("n_now") > F.when(F.col("a") == F.col("b"), 1).otherwise(0)
    best = met.groupBy(F.col("a").alias("key")).agg(F.max(F.when(F.col("n_past") > 0, F.col("similarity"))).alias("memory"), F.max(F.when(others, F.col("similarity"))).alias("batch"))
    counts = new.groupBy("link").agg(F.count("*").alias("n"))
    known = rows.where("past").select("said").distinct().withColumn("known", F.lit(True))
    joined = new.join(counts, "link").join(best, "key", "left").join(known, "said", "left")
    score = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return joined.select(
        "doc_id", (F.col("n") > 1).alias("same_link"), score("memory").alias("memory"), score("batch").alias("batch"), (F.coalesce("known", F.lit(False)) & (F.col("said") != "")).alias("guarded"),
        ((F.col("n") > 1) | F.col("memory").isNotNull() | F.col("batch").isNotNull()).alias("duplicate"),
    )


#: Terms of secondary scores: word or phrase, part, points each, and phrases that take an urgent term back.
TERMS = (
    ("the", "search", 3, ()), ("of the", "search", 3, ()), ("que", "search", 3, ()), ("und", "search", 3, ()),
    ("is", "inquiry", 4, ()), ("est", "inquiry", 4, ()), ("ist", "inquiry", 4, ()), ("es", "inquiry", 4, ()), ("that", "inquiry", 4, ()),
    ("to", "utility", 2, ()), ("in the", "utility", 2, ()), ("pour", "utility", 2, ()), ("mit", "utility", 2, ()), ("para", "utility", 2, ()),
    ("an", "region", 6, ()), ("von", "region", 6, ()), ("la", "region", 6, ()), ("des", "region", 6, ()), ("on", "town", 3, ()), ("der", "town", 3, ()), ("los", "town", 3, ()), ("une", "town", 3, ()),
    ("with", "urgent", 20, ("by the", "the by")), ("del", "urgent", 20, ("de los",)), ("das", "urgent", 20, ("von der",)),
    ("and", "triangle", 0, ()), ("by", "triangle", 0, ()), ("for", "triangle", 0, ()), ("et", "triangle", 0, ()), ("y", "triangle", 0, ()),
)
CAPS = (("search", 8, "sum"), ("inquiry", 12, "sum"), ("utility", 6, "sum"), ("region", 20, "sum"), ("town", 15, "sum"), ("urgent", 20, "max"), ("triangle", 0, "sum"))
_WORDED = r"' ' || trim(regexp_replace(strip_accents(lower(coalesce(text, ''))), '[^\p{L}\p{N}]+', ' ', 'g')) || ' '"


def _points(part: str, cap: int) -> str:
    held = lambda term, unless: f"(contains(t, ' {term} ')" + "".join(f" AND NOT contains(t, ' {u} ')" for u in unless) + ")::INT"
    own = [f"{each} * {held(term, unless)}" for term, p, each, unless in TERMS if p == part]
    return f"least({cap}, " + (f"greatest({', '.join(own)})" if part == "urgent" else " + ".join(own)) + ")"


@query(f"""WITH d AS (SELECT doc_id, n_chars, {_WORDED} AS t FROM documents), n AS (SELECT *, {" + ".join(f"contains(t, ' {term} ')::INT" for term, p, _, _ in TERMS if p == "triangle")} AS n FROM d),
s AS (SELECT doc_id, n_chars, {", ".join(f"{_points(p, cap)} AS {p}" for p, cap, _ in CAPS[:-1])}, CASE WHEN n >= 3 THEN 15 WHEN n = 2 THEN 7 ELSE 0 END AS triangle FROM n)
SELECT doc_id, search, inquiry, utility, region + town AS region, urgent, triangle, greatest(0, least(100, 20 + search + inquiry + utility + region + town + urgent + triangle + CASE WHEN n_chars > 900 THEN 10 ELSE 0 END - CASE WHEN n_chars < 120 THEN 25 ELSE 0 END)) AS combined FROM s""")
def secondary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by a table of terms in whole texts: search, inquiry, utility, regional pairs, urgency that other phrases take back, triangulation, and their sum."""
    docs = read_table(spark, sf_dir, "documents")
    table = spark.createDataFrame([(t, p, w, list(u)) for t, p, w, u in TERMS], "term string, part string, weight int, unless array<string>")
    scored = terms.part_scores(terms.match_terms(docs, table, "doc_id", "text"), spark.createDataFrame(CAPS, "part string, cap int, mode string"), "doc_id")
    points = [F.coalesce(F.sum(F.when(F.col("part") == p, F.col("points"))), F.lit(0)).cast("int").alias(p) for p, _, _ in CAPS[:-1]]
    n = F.coalesce(F.sum(F.when(F.col("part") == "triangle", F.col("hits"))), F.lit(0))
    by = scored.groupBy("doc_id").agg(*points, F.when(n >= 3, 15).when(n == 2, 7).otherwise(0).alias("triangle"))
    names = [p for p, _, _ in CAPS]
    rows = docs.select("doc_id", "n_chars").join(by, "doc_id", "left").na.fill(0, names)
    total = sum((F.col(p) for p in names), F.lit(20)) + F.when(F.col("n_chars") > 900, 10).otherwise(0) - F.when(F.col("n_chars") < 120, 25).otherwise(0)
    return rows.select("doc_id", "search", "inquiry", "utility", (F.col("region") + F.col("town")).alias("region"), "urgent", "triangle", clamp(total, 0, 100).cast("int").alias("combined"))


@query(SQL + """SELECT doc_id, CASE WHEN contains(source, '1') THEN 'Source One' WHEN source IS NULL THEN '' ELSE source END AS name, score + CASE WHEN score >= 60 THEN 6 WHEN score < 30 THEN -10 ELSE 0 END AS audience,
  CASE WHEN source IN ('src3', 'src5') OR ends_with(source, '7') THEN true ELSE false END AS bypass,
  CASE WHEN n_chars < 120 THEN 'BLOCKER' WHEN n_chars < 600 THEN 'FIXABLE' ELSE 'WARNING' END AS class, n_chars >= 120 AND n_chars < 600 AS short_accepted, n_chars = 0 OR n_chars < 700 OR (n_chars < 900 AND contains(lower(title), 'the')) AS aggregator FROM stories""")
def row_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display name of a source, score after audience, sources that pass without a score, class of an error, and short or aggregated texts."""
    c = F.col
    short = c("n_chars")
    return stories(spark, sf_dir).select(
        "doc_id",
        F.when(F.contains("source", F.lit("1")), "Source One").otherwise(F.coalesce("source", F.lit(""))).alias("name"),
        (c("score") + F.when(c("score") >= 60, 6).when(c("score") < 30, -10).otherwise(0)).alias("audience"),
        F.coalesce(c("source").isin("src3", "src5") | c("source").endswith("7"), F.lit(False)).alias("bypass"),
        F.when(short < 120, "BLOCKER").when(short < 600, "FIXABLE").otherwise("WARNING").alias("class"),
        ((short >= 120) & (short < 600)).alias("short_accepted"),
        ((short < 700) | ((short < 900) & gates.any_term(F.lower("title"), ("the",)))).alias("aggregator"),
    )


@query("""WITH u AS (SELECT page_id, lower(regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '/+$', '')) AS key, regexp_extract(url, '^(.*?://[^/?#]*)', 1) AS root FROM pages WHERE url IS NOT NULL AND url <> ''),
f AS (SELECT arg_min(root, page_id) AS root, key, min(page_id) AS page_id FROM u GROUP BY key)
SELECT page_id, key, array_to_string([root || p FOR p IN ['/feed', '/feed/', '/rss', '/rss.xml', '/atom.xml', '/feeds/posts/default', '/index.xml']], ' ') AS feeds, row_number() OVER (PARTITION BY root ORDER BY page_id) AS ordinal FROM f""")
def source_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources once by address, the first wins, numbered within their site, with the addresses where a feed may be."""
    from pyspark.sql import Window

    rows = read_table(spark, sf_dir, "pages").where("url is not null and url <> ''")
    own = rows.select("page_id", F.lower(F.regexp_replace(F.regexp_extract("url", "^([^?#]*)", 1), "/+$", "")).alias("key"), F.regexp_extract("url", "^(.*?://[^/?#]*)", 1).alias("root"))
    first = own.groupBy("key").agg(F.min(F.struct("page_id", "root")).alias("f")).select("key", "f.page_id", "f.root")
    # Where sites keep their feeds
    paths = ("/feed", "/feed/", "/rss", "/rss.xml", "/atom.xml", "/feeds/posts/default", "/index.xml")
    ordinal = F.row_number().over(Window.partitionBy("root").orderBy("page_id"))
    return first.select("page_id", "key", F.concat_ws(" ", *[F.concat("root", F.lit(p)) for p in paths]).alias("feeds"), ordinal.alias("ordinal"))


@query("""WITH t AS (SELECT doc_id, substr(split_part(text, chr(10), 1), 1, 80) || ' - ' || source AS t, source FROM documents)
SELECT doc_id, regexp_replace(t, ' - [^-]*$', '') AS title, regexp_extract(t, ' - ([^-]*)$', 1) AS name, array_to_string(list_transform(list_filter(string_split(source || ', ,' || source || ';x', ','), lambda x: trim(x) <> ''), lambda x: trim(x)), '|') AS tags FROM t""")
def title_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles parted from the source at their end, and tags read from a list in text."""
    said = F.concat(F.substring(F.substring_index("text", "\n", 1), 1, 80), F.lit(" - "), F.col("source"))
    own = read_table(spark, sf_dir, "documents").select("doc_id", said.alias("t"), "source")
    tags = F.transform(F.filter(F.split(F.concat("source", F.lit(", ,"), "source", F.lit(";x")), ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x))
    return own.select("doc_id", F.regexp_replace("t", " - [^-]*$", "").alias("title"), F.regexp_extract("t", " - ([^-]*)$", 1).alias("name"), F.array_join(tags, "|").alias("tags"))


@query("""WITH l AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']([^"'']+)', 1)) AS link FROM pages),
k AS (SELECT page_id, host, link, starts_with(link, 'http') AS whole, regexp_matches(lower(link), '\\.(jpg|png|css|js|pdf)($|\\?)') AS asset FROM l)
SELECT host, count(*) AS n, count(*) FILTER (whole AND NOT asset) AS useful, count(DISTINCT link) AS different, count(*) FILTER (asset) AS assets FROM k GROUP BY host""".replace("\\\\", "\\"))
def feed_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How useful each site's links are: all, absolute ones without assets, distinct ones, assets."""
    found = F.regexp_extract_all("html", F.lit(r"""(?i)href\s*=\s*["']([^"']+)"""), F.lit(1))
    rows = read_table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.explode(found).alias("link"))
    asset = F.rlike(F.lower("link"), F.lit(r"\.(jpg|png|css|js|pdf)($|\?)"))
    useful = F.col("link").startswith("http") & ~asset
    return rows.groupBy("host").agg(F.count("*").alias("n"), F.count_if(useful).alias("useful"), F.count_distinct("link").alias("different"), F.count_if(asset).alias("assets"))


@query(f"""WITH t AS (SELECT DISTINCT {FOLD.format("source || ' ' || lang")} AS term, source FROM documents), a AS (SELECT source, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY source)
SELECT term, n, first, n > 60 AS profiled FROM t JOIN a USING (source) WHERE n > 5""")
def active_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that are still active, once by folded form, and whether their source has a profile."""
    docs = read_table(spark, sf_dir, "documents")
    terms = docs.select(fold(F.concat("source", F.lit(" "), "lang")).alias("term"), "source").distinct()
    active = docs.groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 5")
    return terms.join(active, "source").select("term", "n", "first", (F.col("n") > 60).alias("profiled"))


@query("""WITH d AS (SELECT doc_id, text, length(regexp_replace(coalesce(text, ''), '[^.!?]', '', 'g')) AS marks, n_chars FROM documents)
SELECT doc_id, least(5000, n_chars) - 450 * contains(lower(coalesce(text, '')), 'click here')::INT - CASE WHEN marks * 400 < n_chars THEN 350 ELSE 0 END + CASE WHEN marks > 3 THEN 200 ELSE 0 END + CASE WHEN contains(coalesce(text, ''), chr(10)) THEN 500 ELSE 0 END AS score,
  floor(n_chars / 8.0)::BIGINT + 80 * (len(string_split(coalesce(text, ''), chr(10))) - 1) + 12 * marks AS node FROM d""")
def article_text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much a text looks like an article's, and like the node of a page that holds one."""
    said = F.coalesce("text", F.lit(""))
    own = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars", said.alias("s"), F.length(F.regexp_replace(said, "[^.!?]", "")).alias("marks"))
    c, when = F.col, lambda test, value: F.when(test, value).otherwise(0)
    score = F.least(F.lit(5000), c("n_chars")) - when(F.contains(F.lower("s"), F.lit("click here")), 450) - when(c("marks") * 400 < c("n_chars"), 350) + when(c("marks") > 3, 200) + when(F.contains("s", F.lit("\n")), 500)
    return own.select("doc_id", score.cast("long").alias("score"), (F.floor(c("n_chars") / 8) + 80 * (F.size(F.split("s", "\n")) - 1) + 12 * c("marks")).cast("long").alias("node"))
