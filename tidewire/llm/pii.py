"""Personal data: base patterns with spans, and identifiers found by bootstrapping their contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import Scratch, in_blocks, let, starts_of, text_key

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Possessive quantifiers and the look-behinds find the same matches as the plain
#: forms, in linear time and without recursion on long texts.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Without these characters there is no match, so the pattern is not run.
NEEDS = {"email": "[@]", "ip": "[0-9]", "card": "[0-9]", "phone": "[+]"}
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: A word that can be an identifier: it holds a digit, or a mark that joins parts of names and addresses, or begins as a handle.
TOKEN = r"(?<!\S)(?=[^\s0-9]*+[0-9]|[@#][A-Za-z]|\S*?[A-Za-z][@_#=/\\(\[][A-Za-z])\S++"
#: A seed besides the base kinds: a long key of letters and digits.
SECRET = r"^(?=[^0-9]*+[0-9])(?=[^A-Za-z]*+[A-Za-z])[A-Za-z0-9_-]{20,}$"
TOKEN_NEEDS = r"[0-9@_#=/\\(\[]"


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)
    worth = F.transform(
        F.sequence(F.lit(1), F.length(digits)),
        lambda i: (F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)),
    )
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.rlike(match, F.lit(rf"^{PART}(?:\.{PART}){{3}}$"))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _cut(df: DataFrame, name: str, pattern: str, needs: str) -> DataFrame:
    """Adds <name>_m, the matches, <name>_g, the gaps around them, and <name>_s, the starts of the matches."""
    there = F.rlike("text", F.lit(needs))
    df = df.withColumn(f"{name}_m", F.when(there, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(f"{name}_g", F.when(F.size(f"{name}_m") > 0, F.split("text", pattern, -1)))
    sizes = F.transform(f"{name}_m", lambda m, i: F.length(m) + F.length(F.get(f"{name}_g", i)))
    starts = let(starts_of(sizes), lambda at: F.transform(f"{name}_m", lambda m, i: F.get(at, i) + F.length(F.get(f"{name}_g", i))))
    return df.withColumn(f"{name}_s", starts)


def _spans(kind: str) -> Column:
    """Valid matches of a kind as array of (start, end, said)."""
    found = F.transform(
        f"{kind}_m",
        lambda m, i: F.struct(F.get(f"{kind}_s", i).alias("start"), (F.get(f"{kind}_s", i) + F.length(m)).alias("end"), m.alias("said"), _valid(kind, m).alias("ok")),
    )
    return F.transform(F.filter(found, lambda x: x["ok"]), lambda x: F.struct(x["start"], x["end"], x["said"]))


def _span_blocks(spans: Column) -> Column:
    """Spans in order, in blocks of (low, high, own), so that a look-up passes over whole blocks."""
    ordered = F.array_sort(spans)
    blocks = F.transform(in_blocks(ordered), lambda own: F.struct(F.get(own, 0)["start"].alias("low"), F.array_max(F.transform(own, lambda s: s["end"])).alias("high"), own.alias("own")))
    return F.when(F.size(spans) > 0, blocks).otherwise(F.array())


def _mentions() -> Column:
    """Words that can be identifiers as (inst, left, around, start, end, seed, told): what they say (all of the base
    span that they are part of, if any), the lexical patterns around them, where they stand,
    whether they are a seed, and whether they are part of a base span. The patterns try each word of a gap once, from its start.
    Arrays that lambdas look into are bound with ``let``: a column named once in a lambda could be
    merged into it, and would be worked out for every word."""

    def parts(gaps: Column, starts: Column, word: Column, i: Column) -> Column:
        gap, after = F.get(gaps, i), F.get(gaps, i + 1)
        return F.struct(
            F.lower(F.regexp_extract(gap, r"(?<!\S)(\S++)\s*+\z", 1)).alias("near"),
            F.lower(F.regexp_extract(gap, r"(?<!\S)(\S++)\s++\S++\s*+\z", 1)).alias("far"),
            F.lower(F.regexp_extract(after, r"^\s*+(\S++)", 1)).alias("right"),
            F.regexp_replace(word, r"^[^A-Za-z0-9+]++|(?<=[A-Za-z0-9])[^A-Za-z0-9]++\z", "").alias("core"),
            (F.get(starts, i) + F.length(F.regexp_extract(word, r"^[^A-Za-z0-9+]*+", 0))).alias("start"),
            (i > 0).alias("later"),
        )

    def over(blocks: Column, start: Column, end: Column) -> Column:
        """The first base span that shares a character with start to end, or null."""
        near = F.filter(blocks, lambda b: (b["low"] < end) & (b["high"] > start))
        return F.get(F.flatten(F.transform(near, lambda b: F.filter(b["own"], lambda s: (s["start"] < end) & (s["end"] > start)))), 0)

    def mention(blocks: Column, w: Column) -> Column:
        end = w["start"] + F.length(w["core"])
        # a gap of less than two words goes on in the identifier before it
        left = F.concat_ws(" ", F.when(w["far"] != "", w["far"]).when(w["later"], "<id>").otherwise("<start>"), F.when(w["near"] != "", w["near"]).otherwise("<id>"))
        around = F.concat_ws(" ", w["near"], F.lit("_"), F.when(w["right"] != "", w["right"]).otherwise("<end>"))
        return let(
            over(blocks, w["start"], end),
            lambda base: F.struct(
                F.lower(F.coalesce(base["said"], w["core"])).alias("inst"),
                left.alias("left"),
                around.alias("around"),
                w["start"].alias("start"),
                end.alias("end"),
                (base.isNotNull() | F.rlike(w["core"], F.lit(SECRET))).alias("seed"),
                base.isNotNull().alias("told"),
            ),
        )

    words = let(F.col("token_g"), lambda gaps: let(F.col("token_s"), lambda starts: F.transform("token_m", lambda word, i: parts(gaps, starts, word, i))))
    return let(F.col("span_blocks"), lambda blocks: F.transform(words, lambda w: mention(blocks, w)))


def find_pii(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rounds: int = 3,
    confidence: float = 0.6,
    seeds: int = 2,
    min_chars: int = 6,
) -> DataFrame:
    """(id, email, ip, card, phone, context): arrays of (start, end) in characters, end exclusive.

    The base kinds are leftmost non-overlapping matches that pass their checks. They, and keys of 20 or
    more letters and digits, are the seeds of the bootstrapped kind ``context``: every word with a digit, or with one of the marks @_#=/\\([ between letters, is
    an instance (words of letters alone are none: a trusted slot holds too many that say nothing of
    a person); the two words before it, and the words on both sides, are its lexical patterns. A pattern scores the mean of its
    distinct instances' scores, with one unscored instance added; an instance that is no seed
    scores one minus the product of its patterns' doubts. After ``rounds`` rounds over the graph, patterns of
    at least ``confidence`` with ``seeds`` seed instances or more mark the words in their slot that
    have ``min_chars`` characters and touch no base span.

    Null text: empty, no spans. Rows are judged each, so repeated rows and ids get equal results;
    other columns are not read. No rows give no rows. Base spans never change.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pii")
    cut = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    for kind in KINDS:
        cut = _cut(cut, kind, PATTERNS[kind], NEEDS[kind]).withColumn(kind, _spans(kind)).drop(f"{kind}_m", f"{kind}_g", f"{kind}_s")
    cut = _cut(cut, "token", TOKEN, TOKEN_NEEDS).withColumn("span_blocks", _span_blocks(F.concat(*KINDS)))
    places = [F.transform(k, lambda s: F.struct(s["start"], s["end"])).alias(k) for k in KINDS]
    base = scratch.keep(cut.select("id", text_key(F.col("text")).alias("key"), *places, _mentions().alias("mentions")), "base")

    mentions = base.where(F.size("mentions") > 0).select("key", F.inline("mentions"))
    pairs = mentions.select("key", "inst", "start", "end", "seed", "told", F.explode(F.array(F.concat(F.lit("L "), "left"), F.concat(F.lit("A "), "around"))).alias("pattern"))
    graph = scratch.keep(pairs.groupBy("pattern", "inst").agg(F.max("seed").alias("here")), "graph")
    known = graph.groupBy("inst").agg(F.max("here").alias("seed"))
    scores = scratch.keep(known.select("inst", "seed", F.col("seed").cast("double").alias("score")), "scores-0")
    for step in range(1, rounds + 1):
        patterns = graph.join(scores, "inst").groupBy("pattern").agg((F.sum("score") / (F.count("*") + 1)).alias("trust"), F.sum(F.col("seed").cast("int")).alias("n_seeds"))
        patterns = scratch.keep(patterns, f"patterns-{step}")
        doubt = F.exp(F.sum(F.log1p(-F.least(F.col("trust"), F.lit(0.999999)))))
        scores = scratch.keep(
            graph.join(patterns, "pattern").groupBy("inst").agg(doubt.alias("doubt")).join(known, "inst").select("inst", "seed", F.when(F.col("seed"), 1.0).otherwise(1 - F.col("doubt")).alias("score")),
            f"scores-{step}",
        )
        scratch.drop(f"scores-{step - 1}")
    good = patterns.where((F.col("trust") >= confidence) & (F.col("n_seeds") >= seeds)).select("pattern")
    found = (
        pairs.where(~F.col("told") & (F.length("inst") >= min_chars))
        .join(good, "pattern", "left_semi")
        .groupBy("key")
        .agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("context"))
    )
    return base.join(found, "key", "left").select(F.col("id").alias(id_col), *KINDS, F.coalesce("context", F.array().cast("array<struct<start:int,end:int>>")).alias("context"))


def written(kinds: tuple[str, ...]) -> Column:
    """kind:start:end, by kind as listed and then start, comma-joined."""
    def each(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.concat(*map(each, kinds)), ",")
