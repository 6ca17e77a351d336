"""Scores, funnel, anomalies and folds against plain Python, with nulls, ties, empty inputs and repeated rows."""

import random

import pytest
from pyspark.sql import functions as F

from tidewire.functions import text, urls
from tidewire.operators import anomaly, classify, funnel, scoring, severity, state
from tidewire.plans import registry
from tidewire.plans.stories import stories


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def one(spark, column, **row):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'long'}" for k, v in row.items())
    return spark.createDataFrame([tuple(row.values())], schema).select(column).first()[0]


def test_relevance_stops_at_forty(spark):
    args = (("reg",), ("i1", "i2", "i3", "i4", "i5"), ("svc",), ("strong",), r"\btoday\b", ("poor",))
    got = lambda t: one(spark, scoring.relevance(F.col("t"), *args), t=t)
    pad = " " + "x" * 200
    assert got("reg i1 i2 i3 i4 i5" + pad) == 44  # 14, then three of the five
    assert got("i1 i2 i3 i4 i5 svc strong today" + pad) == 68
    assert got("poor") == 0 and got("") == 0 and got(None) == 0


def test_bands_checks_and_destinations(spark):
    assert [one(spark, scoring.band(F.col("n"), (60, "high"), (30, "medium"), least="low"), n=n) for n in (29, 30, 59, 60)] == ["low", "medium", "medium", "high"]
    found = one(spark, scoring.checklist(("a", 60, F.col("n") > 1), ("b", 40, F.lit(None).cast("boolean"))), n=2)
    assert (found.score, found.failed) == (60, ["b"])
    place = lambda fatal, direct, n: one(spark, scoring.destination(F.lit(fatal).cast("boolean"), F.lit(direct).cast("boolean"), F.col("n")), n=n)
    assert [place(True, True, 99), place(None, True, 90), place(False, None, 90), place(False, True, 34)] == ["block", "publish", "draft", "block"]


def test_an_alias_can_start_the_next(spark):
    aliases = (("beta", ("alpha",), None), ("gamma", ("beta",), "ctx"), ("delta", ("zeta",), None))
    got = lambda t: one(spark, scoring.expand_aliases(F.col("t"), aliases), t=t)
    assert got("alpha ctx") == "alpha ctx beta gamma" and got("alpha") == "alpha beta" and got(None) == ""


def test_words_as_wholes(spark):
    assert one(spark, scoring.repeated_words(F.col("t"), ("go", "no")), t="Go, go! gogo no") == ["go"]
    assert one(spark, scoring.banned_terms(F.col("t"), ("art", "in the end")), t="Smart in the end.") == ["in the end"]
    assert one(spark, scoring.absent_from(scoring.claims(F.col("t")), F.lit("paris saw it")), t="Paris Éclat 42, 7") == ["Éclat", "42"]
    assert one(spark, scoring.watched(F.col("t"), (("a", "b"), ("b", "c")), ("c", "d", "e"), 2, 3), t="abcde") == ["a", "b", "d"]


def test_minimum_quota_follows_the_ordered_pass(spark):
    rng = random.Random(4)
    rows = [(b, i, rng.choice([10, 60, None])) for b in range(6) for i in range(rng.randrange(0, 9))]
    kept = []
    for b in range(6):
        taken = 0
        for row in sorted(r for r in rows if r[0] == b):
            strong = row[2] is not None and row[2] >= 55
            if strong or taken < 2:
                taken += 1
                kept.append((row[0], row[1], not strong))
    df = spark.createDataFrame(rows, "b long, i long, score long")
    assert values(funnel.minimum_quota(df, "b", [F.col("i")], F.col("score") >= 55).select("b", "i", "promoted")) == sorted(kept, key=str)
    assert funnel.minimum_quota(df.limit(0), "b", [F.col("i")], F.col("score") >= 55).count() == 0


def test_run_caps_follow_the_counters(spark):
    rng = random.Random(5)
    rows = [(i, f"s{rng.randrange(4)}") for i in range(60)]
    counts, kept = {}, []
    for i, s in rows:
        if len(kept) < 14 and counts.get(s, 0) < 5:
            counts[s] = counts.get(s, 0) + 1
            kept.append(i)
    df = spark.createDataFrame(rows, "i long, s string").repartition(3)
    assert sorted(r.i for r in funnel.run_caps(df, "s", 5, 14, F.col("i")).collect()) == kept


def test_jobs_merges_and_exclusions(spark):
    jobs = spark.createDataFrame([(1, "a", False), (2, "a", True), (3, "a", True), (4, "a", False), (5, "b", False), (6, "b", None), (7, None, True)], "id long, k string, urgent boolean")
    assert values(funnel.queue_jobs(jobs, "k", F.col("urgent"), F.col("id")).select("k", "id")) == [("a", 3), ("b", 5), (None, 7)]
    configs = spark.createDataFrame([("x", 1, None, 5, "o2"), ("x", 2, "t", 3, "o1"), ("x", 3, "u", None, "o1"), ("y", 4, "", None, "o1")], "k string, i long, title string, cap long, o string")
    merged = funnel.merge_configs(configs, F.col("k"), ["title"], ["cap"], "o", F.col("i"))
    assert values(merged) == [("x", "t", 5, ["o1", "o2"]), ("y", None, None, ["o1"])]
    sources = spark.createDataFrame([(1, "http://A/", "n1"), (2, "http://b", "n2"), (3, None, "n3"), (4, "", "")], "i long, url string, name string")
    special = spark.createDataFrame([("http://a", "z"), ("http://a/", "z"), (None, "n3"), ("", "")], "url string, name string")
    assert values(funnel.without_sources(sources, special, "url", "name").select("i", "removed")) == [(1, True), (2, False), (3, True), (4, False)]
    known = funnel.split_known(sources, special.select(F.substring(F.sha2("name", 256), 1, 20)), F.col("name")).select("i", "known")
    assert values(known) == [(1, False), (2, False), (3, True), (4, True)]


def test_intervals_follow_the_fold(spark):
    rng = random.Random(6)
    rows = [(k, i, rng.choice([True, False, False, None])) for k in (1, 2, 3) for i in range(rng.randrange(0, 30))]
    want = []
    for k in (1, 2, 3):
        now, seen = 1800, []
        for _, i, ok in sorted(r[:2] + (bool(r[2]),) for r in rows if r[0] == k):
            seen.append(ok)
            if len(seen) >= 3:
                if not any(seen[-3:]):
                    now = min(int(now * 1.2), 3600)
                elif sum(seen[-3:]) >= 2:
                    now = max(int(now * 0.85), 300)
            want.append((k, i, now))
    df = spark.createDataFrame(rows, "k long, i long, found boolean").repartition(5)
    assert values(state.adaptive_intervals(df, "k", ["i"], F.col("found"))) == sorted(want, key=str)


def test_planted_outliers_score_highest(spark):
    rng = random.Random(7)
    rows = [(i, rng.gauss(0, 1), rng.gauss(5, 1)) for i in range(400)] + [(1000 + i, 30.0 + i, None) for i in range(5)]
    found = anomaly.anomalies(spark.createDataFrame(rows, "i long, a double, b double"), "i", ["a", "b"], trees=50)
    assert {r.i for r in found.orderBy(F.desc("score")).limit(5).collect()} == set(range(1000, 1005))
    assert 5 <= found.where("anomaly").count() <= 0.06 * len(rows)
    few = anomaly.anomalies(spark.createDataFrame(rows[:9], "i long, a double, b double"), "i", ["a", "b"])
    assert few.where("anomaly or score is not null").count() == 0 and few.count() == 9


def test_severity_on_held_out_labels(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").select("doc_id", "text", (1 - F.col("quality")).cast("double").alias("label"))
    model = severity.fit(rows.where("doc_id % 3 <> 0"), "text", "label", 2, "doc_id", hidden=(16,))
    held = severity.predict(model, rows.where("doc_id % 3 = 0"), "doc_id", "text").join(rows, "doc_id")
    right = held.agg(F.avg((F.col("severity") == F.col("label")).cast("double"))).first()[0]
    plain = rows.agg(F.avg("label")).first()[0]
    assert right >= max(plain, 1 - plain)


def test_greedy_query_follows_the_plain_pass(spark, sf):
    titles = {r.doc_id: set(r.ts) for r in stories(spark, sf).select("doc_id", text.tokens(F.col("title")).alias("ts")).collect()}
    kept = []
    for i in sorted(titles):
        t = titles[i]
        if t and not any(len(t & titles[k]) / len(t | titles[k]) >= 0.65 for k in kept):
            kept.append(i)
    assert sorted(r.doc_id for r in registry.QUERIES["greedy_titles"](spark, sf).collect()) == kept


def test_terms_and_addresses(spark):
    docs = spark.createDataFrame([(1, "alpha alpha beta"), (2, "beta gamma"), (3, None), (4, "")], "id long, text string")
    assert values(classify.top_terms(docs, "id", "text", 1).select("id", "term")) == [(1, "alpha"), (2, "gamma")]
    assert one(spark, urls.secure(F.col("u")), u="http://A.com/p?reference=1&id=2#x") == "https://a.com/p?id=2"
    assert [one(spark, urls.source_kind(F.col("u")), u=u) for u in ("", None, "http://a/s.xml", "http://a/rss", "http://m.a/", "http://a/b")] == ["blank", "blank", "sitemap", "feed", "mobile", "html"]
    assert one(spark, urls.slug_title(F.col("p")), p="/a/big-news_now/") == "Big news now"


def test_folds_keep_null_and_large_keys(spark):
    from tidewire.operators import state

    large = 9007199254740993
    rows = [(k, i, False) for k in (None, large, 1) for i in range(15)]
    found = state.adaptive_thresholds(spark.createDataFrame(rows, "k long, i long, ok boolean"), "k", ["i"], F.col("ok"))
    last = {r["k"]: r["threshold"] for r in found.where("i = 14").collect()}
    assert last == {None: 40, large: 40, 1: 40}
    waits = state.adaptive_intervals(spark.createDataFrame(rows, "k long, i long, ok boolean"), "k", ["i"], F.col("ok"))
    assert {r["k"]: r["seconds"] for r in waits.where("i = 14").collect()} == {None: 3600, large: 3600, 1: 3600}


def test_nearest_vectors_in_blocks(spark):
    from tidewire.operators import vectors

    rows = spark.createDataFrame([(i, [float((i * 7) % 11), float(i % 5), 1.0]) for i in range(60)] + [(99, None)], "id long, v array<double>")
    got = [sorted(map(tuple, vectors.cosine_top_k(rows, rows, "id", "v", 4, block=n).collect())) for n in (1000, 7)]
    assert got[0] == got[1] and len(got[0]) == 240


def test_title_ratios(spark, sf):
    import difflib

    from tidewire.functions.text import fold
    from tidewire.plans.evidence import title_ratios

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lines = {r[0]: r[1:] for r in docs.select("doc_id", *[F.substring(fold(F.get(F.split("text", "\n"), k)), 1, 180) for k in (0, 1)]).collect()}
    got = {r["doc_id"]: (r["ratio"], r["repeats"]) for r in title_ratios(spark, sf).collect()}
    assert set(got) == set(lines)
    for key, (a, b) in lines.items():
        want = None if a is None or b is None else 1.0 if a in b or b in a else round(difflib.SequenceMatcher(None, a, b).ratio(), 6)
        assert got[key][0] == want and got[key][1] == ((want or 0) >= 0.88)


def test_scan_feeds(spark):
    from tidewire.operators.scan import scan_feeds

    rows = [("a", 0, "2024-01-01 00:00:00"), ("a", 1, "2024-01-09 00:00:00"), ("a", 2, "2024-01-09 12:00:00"), ("a", 3, None), ("b", 0, None), ("b", 1, "2023-01-01 00:00:00"), ("b", 2, "2023-02-01 00:00:00"), ("c", 0, None), ("d", 40, "2024-01-09 00:00:00"), ("e", 0, "2024-02-01 00:00:00")]
    items = spark.createDataFrame(rows, "feed string, place int, date string")
    got = {(r["feed"], r["place"], r["rescued"]) for r in scan_feeds(items, F.lit("2024-01-10 00:00:00"), 48, per_feed=1).collect()}
    assert got == {("a", 1, False), ("b", 1, True), ("e", 0, True)}
    assert scan_feeds(items.where("false"), F.lit("2024-01-10 00:00:00"), 48).count() == 0


def test_article_strategies(spark):
    from tidewire.sources.pages import article

    said = "one two three four five six seven eight " * 6
    made = [
        (1, f'<script type="application/ld+json">{{"articleBody": "{said}"}}</script><p>{said}</p>'), (2, f'<script type="application/ld+json">not json</script><div class="x" itemprop="articleBody"><b>{said}</b></div>'),
        (3, f"<p>{said}</p><article><p>{said}</p></article>"), (4, "<p>one two three four five six seven eight nine</p>"), (5, ""), (6, None),
    ]
    got = {r["id"]: r["a"]["strategy"] for r in spark.createDataFrame(made, "id long, html string").select("id", article(F.col("html")).alias("a")).collect()}
    assert got == {1: "json_ld", 2: "itemprop", 3: "article", 4: "paragraphs", 5: "none", 6: "none"}


def test_source_contract_orders_its_reasons(spark):
    """A refused request is refused whatever its text; white space is no text; a missing result is no short one."""
    from tidewire.operators import gates

    long = "x" * 120
    rows = [(200, long, True), (403, long, True), (429, None, True), (403, "", True), (200, None, True), (200, "\n" * 120, True), (200, "\t" + "x" * 119 + "\n", True), (None, long, True), (500, long, True), (403, long, False), (200, long, None)]
    df = spark.createDataFrame(rows, "status int, text string, there boolean")
    got = [r[0] for r in df.select(gates.source_contract(F.col("status"), F.col("text"), present=F.col("there"))).collect()]
    assert got == ["ok", "http_403", "http_429", "http_403", "short", "short", "short", "ok", "ok", "invalid", "invalid"]
    assert [r[0] for r in df.select(gates.source_contract(F.col("status"), F.col("text"))).collect()][-2:] == ["http_403", "ok"]


def test_cosine_top_k_of_text_ids_and_two_widths(spark):
    import numpy as np

    from tidewire.operators import vectors

    rng = np.random.default_rng(3)
    rows = [(f"é{i}", rng.normal(size=3 if i % 3 else 5).tolist()) for i in range(60)] + [("zero", [0.0] * 3), ("none", None), (None, [1.0, 2.0, 3.0]), ("nan", [float("nan")] * 3), ("empty", [])]
    df = spark.createDataFrame(rows, "name string, v array<double>")
    known = {n: np.array(v) for n, v in rows if n and v is not None}
    unit = {n: v / (np.linalg.norm(v) or 1) for n, v in known.items()}
    want = set()
    for q, a in unit.items():
        near = sorted((-round(float(a @ b), 6), i) for i, b in unit.items() if i != q and len(a) == len(b) and np.isfinite(a @ b))
        want |= {(q, i, -s, r) for r, (s, i) in enumerate(near[:4], 1)}
    for block in (1000, 9):
        got = {tuple(r) for r in vectors.cosine_top_k(df, df, "name", "v", 4, block=block).collect()}
        assert {(q, i, r) for q, i, _, r in got} == {(q, i, r) for q, i, _, r in want}
    assert vectors.cosine_top_k(df, df.limit(0), "name", "v", 4).schema["query"].dataType.simpleString() == "string"


def test_query_names_are_taken_once():
    from tidewire.plans import registry

    def ranked_queue(spark, sf_dir):
        return None

    with pytest.raises(ValueError, match="ranked_queue"):
        registry.query()(ranked_queue)


def test_global_rank_deals_by_ranges(spark):
    from tidewire.operators.ranking import global_rank

    rows = spark.range(5000).select("id", (F.col("id") * 37 % 101).alias("x"), F.when(F.col("id") % 9 != 0, F.col("id")).alias("y"))
    order = [F.desc("x"), F.asc_nulls_first("y"), F.asc("id")]
    got = {r["id"]: r["place"] for r in global_rank(rows, order).collect()}
    want = sorted(((-(i * 37 % 101), i % 9 != 0, i) for i in range(5000)))
    assert got == {i: n for n, (_, _, i) in enumerate(want, 1)}
    assert global_rank(rows.limit(0), order).count() == 0
