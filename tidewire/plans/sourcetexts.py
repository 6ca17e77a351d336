"""Source texts cleaned, parted from their metadata and cut into paragraphs: documents with planted lines of a news site between their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.dates import date_in_text
from tidewire.operators import clean
from tidewire.operators.scoring import IMAGE_PARTS, image_url_score
from tidewire.operators.clean import LOWER, NEWS, UPPER, any_of
from tidewire.plans.registry import query
from tidewire.session import read_table

#: Lines that the texts of ``sources`` get, one kind each.
PLANTED = (
    "Leia também", "Notícias relacionadas:", "Copiar link", "Foto: Ana Souza", "Legenda: a ponte", "https://example.com/a?b=1",
    "Publicado em 03/02/2024 às 10:15", "Por Ana Souza", "Continua após a publicidade", "Contexto", "Saiba mais", "|||", "Capa Esportes Cidade",
    "- Outra chamada da lista", "Você tem 5 acessos por dia", "5 min de leitura", "Recurso exclusivo para assinantes", "Vale lembrar que chove.", "", "   ",
    "A imagem mostra um homem de terno azul que fala em voz alta diante de uma parede clara e larga", "© Portal", "Publicidade",
)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, title, t): whole texts with a planted line behind every third of their lines; texts of one line get none."""
    told = F.array(*map(F.lit, PLANTED))

    def line(x: Column, i: Column) -> Column:
        extra = F.get(told, ((F.col("doc_id") * 7 + i) % len(PLANTED)).cast("int"))
        return F.when(i % 3 == 1, F.concat(x, F.lit("\n"), extra)).otherwise(x)

    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.substring(F.substring_index("text", "\n", 1), 1, 40).alias("title"), F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line), "\n").alias("t"))


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '\A\s+|\s+\z', '', 'g')"


def _squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _plain(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower({x})), '[^a-z0-9]+', ' ', 'g'))"


def _has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {_sql(pattern)})"


SOURCES = f"""WITH planted AS (SELECT [{", ".join(map(_sql, PLANTED))}] AS p),
sources AS (SELECT doc_id, substr(split_part(text, chr(10), 1), 1, 40) AS title, array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)),
  lambda x, i: x || CASE WHEN (i - 1) % 3 = 1 THEN chr(10) || p[(doc_id * 7 + i - 1) % {len(PLANTED)} + 1] ELSE '' END), chr(10)) AS t FROM documents, planted)"""
PHRASES = _sql(any_of(NEWS.phrases))
JUNK = f"(regexp_matches(lower(v), {PHRASES}) OR length(v) <= 2 OR regexp_matches(v, '^[-–—•|/\\\\]+$') OR (regexp_matches(v, '^(?:[{UPPER}][{LOWER}]+\\s*){{1,4}}$') AND length(v) < 35) OR (length(v) - length(replace(v, ' - ', '')) >= 9 AND length(v) > 120))".replace("\\\\]", "\\\\]")
MENU = f"(regexp_matches(lower({{0}}), {PHRASES}) OR length({{0}}) - length(replace({{0}}, ' - ', '')) >= 6)"
#: The text from its title, or from the headline before its date; ``article`` holds the lines that stay.
ARTICLE = f"""{SOURCES},
a0 AS (SELECT *, CASE WHEN contains(t, chr(10)) THEN t ELSE regexp_replace(regexp_replace(regexp_replace(t, '\\s+-\\s+', chr(10) || '- ', 'g'), '([^0-9])\\.\\s+([{UPPER}])', '\\1.' || chr(10) || '\\2', 'g'), '([^0-9])\\.[ \\t]+([{UPPER}])', '\\1.' || chr(10) || '\\2', 'g') END AS t1 FROM sources),
a1 AS (SELECT *, instr(reverse(lower(t1)), reverse(lower(title))) AS behind FROM a0),
a2 AS (SELECT *, CASE WHEN length({_plain("title")}) >= 18 AND behind > 0 THEN length(t1) - behind + 1 - length(title) ELSE 0 END AS place FROM a1),
a3 AS (SELECT *, CASE WHEN place > 40 AND ({MENU.format("substr(t1, 1, place)")} OR place > 180) THEN substr(t1, place + 1) ELSE t1 END AS t2 FROM a2),
a4 AS (SELECT *, regexp_matches(substr(t2, 1, 1200), {_sql("(?i)" + NEWS.date)}) AS dated, regexp_extract(substr(t2, 1, 1200), {_sql("(?is)^(.*?)" + NEWS.date)}, 1) AS before FROM a3),
a5 AS (SELECT doc_id, CASE WHEN dated AND contains(before, ' - ') AND {MENU.format("before")} THEN substr(t2, length(before) - length(string_split(before, ' - ')[-1]) + 1) ELSE t2 END AS t3 FROM a4),
a6 AS (SELECT doc_id, unnest(string_split(t3, chr(10))) AS v, generate_subscripts(string_split(t3, chr(10)), 1) AS i FROM a5),
a7 AS (SELECT doc_id, i, regexp_replace({_squeeze("v")}, '^[ |•]+|[ |•]+$', '', 'g') AS v FROM a6),
a8 AS (SELECT *, substr({_plain("v")}, 1, 180) AS key FROM a7 WHERE NOT {JUNK} AND NOT (starts_with(v, '-') AND length(v) < 180 AND NOT {_has("v", "(?i)" + NEWS.date)})),
a9 AS (SELECT * FROM a8 QUALIFY key = '' OR row_number() OVER (PARTITION BY doc_id, key ORDER BY i) = 1),
article AS (SELECT doc_id, {_trim("regexp_replace(coalesce(string_agg(v, chr(10) ORDER BY i), ''), '[ \\t]{2,}', ' ', 'g')")} AS said FROM documents LEFT JOIN a9 USING (doc_id) GROUP BY doc_id)"""


@query(f"""{ARTICLE} SELECT doc_id, md5(said) AS said, length(said) AS n, md5(CASE WHEN length(said) <= 900 THEN said ELSE {_trim("regexp_replace(substr(said, 1, 900), ' [^ ]*$', '')")} END) AS head FROM article""")
def clean_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts without what stands before the article, junk lines, calls and repeated lines; and the same cut to 900 characters at a word."""
    own = sources(spark, sf_dir).select("doc_id", clean.clean_article(F.col("t"), F.col("title"), max_chars=None).alias("s"))
    return own.select("doc_id", F.md5("s").alias("said"), F.length("s").alias("n"), F.md5(clean.cut_at_blank(F.col("s"), 900)).alias("head"))


STATES = f"""{SOURCES},
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM sources),
k AS (SELECT *, {_trim("line")} AS v, lower({_trim("line")}) AS low FROM l),
k0 AS (SELECT doc_id, i, line, v, CASE WHEN low = '' THEN 'blank' WHEN {_has("low", NEWS.section)} THEN 'section'
  WHEN {_trim("regexp_replace(low, ':+$', '')")} IN ({", ".join(map(_sql, NEWS.opener_lines))}) OR {_has("low", NEWS.opener)} THEN 'opener'
  {" ".join(f"WHEN {_has('low', p)}{f' AND length(low) < {n}' if n else ''} THEN '{name}'" for name, p, n in NEWS.kinds)} ELSE 'text' END AS kind FROM k),
k1 AS (SELECT *, coalesce(max(CASE WHEN kind = 'opener' THEN i END) OVER w, 0) > coalesce(max(CASE WHEN kind = 'blank' THEN i END) OVER w, 0) AS inside FROM k0 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
rows AS (SELECT doc_id, i, line, v, CASE WHEN inside AND kind NOT IN ('opener', 'blank') THEN 'related' ELSE kind END AS kind FROM k1)"""


@query(f"""{STATES}, b AS (SELECT doc_id, {_trim("coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (kind IN ('blank', 'section', 'text')), '')")} AS body,
  md5(coalesce(string_agg(kind || ':' || v, chr(10) ORDER BY i) FILTER (kind NOT IN ('blank', 'section', 'text')), '')) AS dropped, count(*) FILTER (kind = 'related') AS related, count(*) FILTER (kind = 'caption') AS captions, count(*) FILTER (kind = 'credit') AS credits FROM rows GROUP BY doc_id)
SELECT doc_id, md5(body) AS body, dropped, related, captions, credits, len(list_filter(string_split(body, chr(10) || chr(10)), lambda x: regexp_matches(x, '\\S'))) AS paragraphs FROM b""")
def metadata_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts parted into the body and what is credits, captions, dates, names, notices and blocks of links."""
    own = sources(spark, sf_dir).select("doc_id", clean.split_metadata(F.col("t")).alias("m")).select("doc_id", "m.*")
    dropped = F.array_join(F.transform("dropped", lambda x: F.concat(x["kind"], F.lit(":"), x["line"])), "\n")
    return own.select("doc_id", F.md5("body").alias("body"), F.md5(dropped).alias("dropped"), *[F.size(c).cast("long").alias(c) for c in ("related", "captions", "credits")], F.col("paragraphs").cast("long").alias("paragraphs"))


@query(f"""{ARTICLE.replace("behind > 0", "false")},
s AS (SELECT doc_id, unnest(string_split(said, chr(10))) AS v, generate_subscripts(string_split(said, chr(10)), 1) AS i FROM article),
f AS (SELECT doc_id, i, v FROM (SELECT doc_id, i, {_squeeze("v")} AS v FROM s) WHERE v <> '' AND NOT {_has("lower(v)", "|".join(NEWS.lines))} AND NOT {_has("lower(v)", any_of(NEWS.markers))} AND NOT (length(v) > 80 AND {_has("lower(v)", any_of(NEWS.pictures))})),
j AS (SELECT doc_id, coalesce(string_agg(v, chr(10) ORDER BY i), '') AS t FROM documents LEFT JOIN f USING (doc_id) GROUP BY doc_id),
c AS (SELECT doc_id, {_trim("regexp_replace(regexp_replace(regexp_replace(t, " + _sql(NEWS.spans[0]) + ", ' ', 'g'), " + _sql(NEWS.spans[1]) + ", ' ', 'g'), '[ \\t]{2,}', ' ', 'g')")} AS t FROM j)
SELECT doc_id, md5(t) AS said, length({_trim("regexp_replace(t, 'https?://\\S+', '', 'g')")}) AS useful FROM c""")
def clean_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts without lines of paywalls, tools and picture descriptions, and the characters that are left without addresses."""
    own = sources(spark, sf_dir).select("doc_id", clean.clean_source(F.col("t"), max_chars=None).alias("s"))
    return own.select("doc_id", F.md5("s").alias("said"), clean.without_addresses(F.col("s")).alias("useful"))


@query(f"""{SOURCES}, l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS v, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM sources),
f AS (SELECT * FROM l WHERE NOT (lower({_trim("v")}) IN ({", ".join(map(_sql, NEWS.noise))}) OR {_has(f"lower({_trim('v')})", "|".join(NEWS.noise_patterns))}))
SELECT doc_id, md5({_trim("coalesce(string_agg(v, chr(10) ORDER BY i), '')")}) AS said, count(i) AS lines FROM documents LEFT JOIN f USING (doc_id) GROUP BY doc_id""")
def writer_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts without the lines that a writer's source leaves out, and how many lines stay."""
    own = sources(spark, sf_dir)
    stays = F.filter(clean.lines_of(F.col("t")), lambda x: ~(F.lower(clean.trimmed(x)).isin(*NEWS.noise) | clean.has(F.lower(clean.trimmed(x)), "|".join(NEWS.noise_patterns))))
    return own.select("doc_id", F.md5(clean.clean_notes(F.col("t"))).alias("said"), F.size(stays).cast("long").alias("lines"))


#: Blocks: the lines of ``sources`` with a blank line behind every fourth.
BLOCKS = f"{SOURCES}, body AS (SELECT doc_id, array_to_string(list_transform(string_split(t, chr(10)), lambda x, i: x || CASE WHEN i % 4 = 0 THEN chr(10) || ' ' ELSE '' END), chr(10)) AS t FROM sources)"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.transform(F.split("t", "\n"), lambda x, i: F.when(i % 4 == 3, F.concat(x, F.lit("\n "))).otherwise(x))
    return sources(spark, sf_dir).select("doc_id", F.array_join(lines, "\n").alias("t"))


HEADING = f"{_plain('{0}')} IN ({', '.join(map(_sql, NEWS.headings))})"


@query(f"""{BLOCKS}, b AS (SELECT doc_id, unnest(regexp_split_to_array(t, '\\n\\s*\\n')) AS b, generate_subscripts(regexp_split_to_array(t, '\\n\\s*\\n'), 1) AS i FROM body),
p AS (SELECT doc_id, i, list_filter(list_transform(string_split(b, chr(10)), lambda x: {_squeeze("x")}), lambda x: x <> '') AS p FROM b),
v AS (SELECT doc_id, i, array_to_string(CASE WHEN len(p) > 1 AND {HEADING.format("p[1]")} THEN p[2:] ELSE p END, ' ') AS v FROM p),
f AS (SELECT doc_id, i, {_squeeze(f"regexp_replace(v, {_sql(r'(?i)' + chr(92) + 'b(?:' + any_of(NEWS.fillers) + ')' + chr(92) + 'b')}, '', 'g')")} AS v FROM v WHERE v <> '' AND NOT {HEADING.format("v")} AND NOT {JUNK})
SELECT doc_id, md5(coalesce(string_agg(v, chr(10) || chr(10) ORDER BY i) FILTER (v <> ''), '')) AS said, count(v) FILTER (v <> '') AS blocks FROM documents LEFT JOIN f USING (doc_id) GROUP BY doc_id""")
def clean_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of whole texts without headings, junk and filling phrases."""
    own = _blocks(spark, sf_dir).select("doc_id", clean.clean_body(F.col("t")).alias("s"))
    return own.select("doc_id", F.md5("s").alias("said"), F.when(F.col("s") == "", 0).otherwise(F.size(F.split("s", "\n\n"))).cast("long").alias("blocks"))


#: Texts as one block each, and the sentences of such a block with their running lengths.
ONE = f"one AS (SELECT doc_id, {_squeeze('coalesce(text, {0})').format(_sql(''))} AS t FROM documents)"


@query(f"""WITH RECURSIVE {ONE},
s AS (SELECT doc_id, t, CASE WHEN t = '' THEN []::VARCHAR[] WHEN length(t) <= 900 THEN [t] ELSE string_split(regexp_replace(t, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)) END AS s FROM one),
w AS (SELECT doc_id, len(s) AS n, list_transform(s, lambda x: length(x)) AS sizes FROM s),
g AS (SELECT doc_id, n, sizes, 0 AS i, 0 AS open, 0 AS done, ''::VARCHAR AS lens FROM w
  UNION ALL SELECT doc_id, n, sizes, i + 1, CASE WHEN ends THEN 0 ELSE longer END, done + ends::INT, CASE WHEN ends THEN lens || longer || ',' ELSE lens END
  FROM (SELECT *, CASE WHEN open = 0 THEN sizes[i + 1] ELSE open + 1 + sizes[i + 1] END AS longer, (CASE WHEN open = 0 THEN sizes[i + 1] ELSE open + 1 + sizes[i + 1] END) >= 260 OR n = 1 AS ends FROM g WHERE i < n))
SELECT doc_id, done + (open > 0)::INT AS n, md5(lens || CASE WHEN open > 0 THEN open || ',' ELSE '' END) AS lengths FROM g WHERE i = n""")
def paragraph_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of one block cut into paragraphs of 260 characters or more, each up to the end of a sentence."""
    said = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    own = read_table(spark, sf_dir, "documents").select("doc_id", clean.paragraphs(said).alias("p"))
    return own.select("doc_id", F.size("p").alias("n"), F.md5(F.array_join(F.transform("p", lambda x: F.concat(F.length(x).cast("string"), F.lit(","))), "")).alias("lengths"))


@query(f"""WITH {ONE},
s AS (SELECT doc_id, t, CASE WHEN t = '' THEN [''] ELSE string_split(regexp_replace(regexp_replace(t, '([.!?]) ([A-ZÁÀÃÂÉÊÍÓÔÕÚÜÇ])', '\\1' || chr(1) || '\\2', 'g'), '([.!?]) ([A-ZÁÀÃÂÉÊÍÓÔÕÚÜÇ])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) END AS s FROM one)
SELECT doc_id, len(s) AS sentences, md5(CASE WHEN len(s) < 4 THEN array_to_string(s, chr(10) || chr(10)) ELSE array_to_string(list_transform(range(1, len(s) + 1, 2), lambda i: array_to_string(s[i:i + 1], ' ')), chr(10) || chr(10)) END) AS said FROM s""")
def repaired_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of one line cut into paragraphs of two sentences."""
    said = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    sentences = F.size(F.split(said, r"(?<=[.!?]) (?=[A-ZÁÀÃÂÉÊÍÓÔÕÚÜÇ])"))
    return read_table(spark, sf_dir, "documents").select("doc_id", sentences.cast("long").alias("sentences"), F.md5(clean.repaired_paragraphs(said)).alias("said"))


_WORTH = " + ".join(f"{worth} * (" + " + ".join(f"contains(u, '{w}')::INT" for w in words) + ")" for words, worth in IMAGE_PARTS)
_STAMP = "lpad((doc_id % 31 + 1)::VARCHAR, 2, '0') || '/' || (doc_id % 14) || '/' || (2000 + doc_id % 27)"


@query(f"""WITH d AS (SELECT doc_id, 'Em ' || {_STAMP} || CASE doc_id % 4 WHEN 0 THEN ' às ' || (doc_id % 26) || 'h' || lpad((doc_id % 60)::VARCHAR, 2, '0') WHEN 1 THEN ' - ' || (doc_id % 24) || ':07' ELSE '' END || ' e 01/02/2003. ' || coalesce(text, '') AS t FROM documents),
p AS (SELECT doc_id, regexp_extract(lower(t), '([0-9]{{1,2}})/([0-9]{{1,2}})/([0-9]{{4}})\\s*(?:às|as|-)?\\s*([0-9]{{1,2}})[:h]([0-9]{{2}})\\b', ['d', 'm', 'y', 'h', 'i']) AS a, regexp_extract(lower(t), '([0-9]{{1,2}})/([0-9]{{1,2}})/([0-9]{{4}})\\b', ['d', 'm', 'y']) AS b FROM d)
SELECT doc_id, coalesce(try_strptime(a.y || '-' || lpad(a.m, 2, '0') || '-' || lpad(a.d, 2, '0') || ' ' || lpad(a.h, 2, '0') || ':' || a.i, '%Y-%m-%d %H:%M'), try_strptime(b.y || '-' || lpad(b.m, 2, '0') || '-' || lpad(b.d, 2, '0'), '%Y-%m-%d')) AS at FROM p""")
def dates_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date of whole texts that begin with a day, some with a time, some of them no real ones."""
    c = F.col
    stamp = F.concat(F.lpad((c("doc_id") % 31 + 1).cast("string"), 2, "0"), F.lit("/"), c("doc_id") % 14, F.lit("/"), 2000 + c("doc_id") % 27)
    time = F.when(c("doc_id") % 4 == 0, F.concat(F.lit(" às "), c("doc_id") % 26, F.lit("h"), F.lpad((c("doc_id") % 60).cast("string"), 2, "0"))).when(c("doc_id") % 4 == 1, F.concat(F.lit(" - "), c("doc_id") % 24, F.lit(":07"))).otherwise("")
    said = F.concat(F.lit("Em "), stamp, time, F.lit(" e 01/02/2003. "), F.coalesce("text", F.lit("")))
    return read_table(spark, sf_dir, "documents").select("doc_id", date_in_text(said).alias("at"))


@query(f"""WITH i AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)(?:src|href)\\s*=\\s*["'']?([^"''\\s>]+)', 1)) AS u0 FROM pages), l AS (SELECT page_id, u0, lower(u0 || CASE length(u0) % 5 WHEN 0 THEN '/Foto-1200.jpg' WHEN 1 THEN '/logo.png' WHEN 2 THEN '/wp-content/full.webp' ELSE '' END) AS u FROM i)
SELECT page_id, count(*) AS n, max({_WORTH})::INTEGER AS best, min({_WORTH})::INTEGER AS worst FROM l GROUP BY page_id""")
def image_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best and the worst address of each page as a picture's."""
    found = F.regexp_extract_all("html", F.lit(r"""(?i)(?:src|href)\s*=\s*["']?([^"'\s>]+)"""), F.lit(1))
    rows = read_table(spark, sf_dir, "pages").select("page_id", F.explode(found).alias("u"))
    kind = F.length("u") % 5
    end = F.when(kind == 0, "/Foto-1200.jpg").when(kind == 1, "/logo.png").when(kind == 2, "/wp-content/full.webp").otherwise("")
    score = image_url_score(F.concat("u", end))
    return rows.groupBy("page_id").agg(F.count("*").alias("n"), F.max(score).alias("best"), F.min(score).alias("worst"))
