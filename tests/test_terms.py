"""Dictionary matching against a plain pass over every text, with 100,000 phrases."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from tidewire.operators import terms


def form(text):
    low = "".join(c for c in unicodedata.normalize("NFD", (text or "").lower()) if unicodedata.category(c) != "Mn")
    return re.sub(r"[\W_]+", " ", low).strip()


def test_a_hundred_thousand_phrases(spark):
    rng = random.Random(1)
    table = spark.range(100_000).select(
        F.when(F.col("id") % 3 == 0, F.format_string("w%d", "id")).when(F.col("id") % 3 == 1, F.format_string("W%d, x%d", "id", F.col("id") % 7)).otherwise(F.format_string("w%d w%d É", "id", F.col("id") + 1)).alias("term"),
        F.concat(F.lit("p"), F.col("id") % 4).alias("part"), (F.col("id") % 5).cast("int").alias("weight"),
        F.when(F.col("id") % 6 == 0, F.array(F.format_string("c%d", F.col("id") % 3))).alias("context"),
        F.when(F.col("id") % 10 == 0, F.array(F.lit("stop it"))).alias("unless"),
    )
    rows = [(i, " ".join(rng.choice([f"w{(n := rng.randrange(3000))}", f"w{n} x{n % 7}", f"w{n} w{n + 1} é", "c0", "stop", "it!"]) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    texts = spark.createDataFrame(rows, "id long, text string")
    got = {tuple(r) for r in terms.match_terms(texts, table).collect()}
    own = [(form(r["term"]), r["part"], r["weight"], r["context"] or [], r["unless"] or []) for r in table.where("id < 4000 or id > 99990").collect()]
    want = set()
    for i, text in rows:
        said = f" {form(text)} "
        has = lambda p, said=said: f" {form(p)} " in said
        want |= {(i, part, t, weight) for t, part, weight, context, unless in own if f" {t} " in said and (not context or any(map(has, context))) and not any(map(has, unless))}
    assert got == want and len(want) > 1500
    parts = spark.createDataFrame([("p0", 5, "sum"), ("p1", None, "sum"), ("p2", 100, "max"), ("p9", 1, "sum")], "part string, cap int, mode string")
    scored = terms.part_scores(spark.createDataFrame(sorted(want), "id long, part string, term string, weight int"), parts)
    by = {}
    for i, part, _, weight in want:
        by.setdefault((i, part), []).append(weight)
    points = {(i, p): (len(v), min(5, sum(v)) if p == "p0" else sum(v) if p == "p1" else max(v)) for (i, p), v in by.items() if p != "p3"}
    assert {(r["id"], r["part"]): (r["hits"], r["points"]) for r in scored.collect()} == points
    for r in terms.composite_score(scored, ["p0", "p1", "p2"], base=3, high=40, least_hits=3).collect():
        assert r["score"] == min(40, 3 + sum(points.get((r["id"], p), (0, 0))[1] for p in ("p0", "p1", "p2")))
        assert r["reasons"] == [p for p in ("p0", "p1", "p2") if points.get((r["id"], p), (0, 0))[0] >= 3]


def test_edges(spark):
    texts = spark.createDataFrame([(1, None), (2, ""), (None, "Só um"), (None, "outro TERMO"), (3, "termo, termo; um"), (4, "a " * 200_000 + "termo")], "id long, text string")
    table = spark.createDataFrame([("Termo", "a", 2), ("termo ", "a", 7), ("termo", "b", None), ("…", "a", 1), (None, "a", 1), ("um", None, 5), ("só  um", "a", 1)], "term string, part string, weight int")
    got = sorted(map(tuple, terms.match_terms(texts, table).collect()), key=str)
    assert got == sorted([(None, "a", "so um", 1), (None, "a", "termo", 7), (None, "b", "termo", 0), (3, "a", "termo", 7), (3, "b", "termo", 0), (4, "a", "termo", 7), (4, "b", "termo", 0)], key=str)
    assert terms.match_terms(texts, table.limit(0)).count() == terms.match_terms(texts.limit(0), table).count() == 0
