"""Operators without SQL, and edge cases, against plain Python."""

import json
import random
import re
import tempfile

from pyspark.sql import functions as F

from tidewire.functions import text, urls
from tidewire.operators import dedup, history, ranking, state, vectors
from tidewire.plans import registry
from tidewire.sources import pages, tables
from tidewire.streaming import cycles


def plain_tokens(title):
    return set(re.sub(r"[^\w\s]", "", (title or "").lower()).split())


def likeness(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def test_greedy_leaders_follow_the_order(spark, tmp_path):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(12)]
    titles = [(i, " ".join(rng.sample(words, rng.randrange(2, 6)))) for i in range(120)]
    kept = []
    for i, t in titles:
        if not any(likeness(plain_tokens(t), plain_tokens(k)) >= 0.65 for _, k in kept):
            kept.append((i, t))
    rows = spark.createDataFrame(titles, "id long, title string").withColumn("ts", text.tokens(F.col("title")))
    pairs = dedup.similar_pairs(rows, "id", "ts", 0.65)
    leaders = rows.groupBy("ts").agg(F.min("id").alias("id")).select("id")

    def save(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{tmp_path}/{name}")

    got = dedup.greedy_leaders(leaders, pairs, save)
    assert {r["id"] for r in got.collect()} == {i for i, _ in kept}


def test_adaptive_threshold(spark, sf):
    rows = sorted((r["user_id"], r["ts"], r["event_id"], r["value"] > 40) for r in spark.read.parquet(f"{sf}/events.parquet").collect())
    want, held = {}, None
    for user, _, event, ok in rows:
        if user != held:
            held, now, last = user, 65, []
        last = [*last, ok][-50:]
        if len(last) >= 10:
            rate = sum(last) / len(last)
            now = max(40, now - 5) if rate < 0.1 else min(90, now + 5) if rate > 0.6 else now
        want[event] = now
    got = registry.QUERIES["adaptive_threshold"](spark, sf).collect()
    assert {r["event_id"]: r["threshold"] for r in got} == want


def test_keyed_dedup_edges(spark):
    rows = spark.createDataFrame([(1, "", 5), (2, "a", 50), (3, "a", 90), (4, None, 1), (5, "b", 90)], "id long, k string, score int")
    best = lambda **x: sorted(r["id"] for r in dedup.keep_best(rows, F.col("k"), -F.col("score"), F.col("id"), **x).collect())
    assert best() == [3, 5] and best(drop_empty=False) == [1, 3, 4, 5]


def test_caps_and_quota(spark):
    rows = spark.createDataFrame([(i, "a" if i < 6 else "b", f"s{i % 2}", i * 10) for i in range(8)], "id long, c string, s string, score int")
    order = (F.desc("score"), F.col("id"))
    topped = ranking.with_quota(rows, F.col("score") >= 60, "c", {"a": 2}, *order)
    assert sorted((r["id"], r["topped"]) for r in topped.collect()) == [(4, True), (5, True), (6, False), (7, False)]
    assert sorted(r["id"] for r in ranking.cascaded_caps(topped, "c", 1, "s", 1, *order).collect()) == [4, 7]


def test_upsert_and_fill(spark):
    old = spark.createDataFrame([(1, "x", "deleted"), (2, "", "ok")], "id long, v string, s string")
    new = spark.createDataFrame([(1, "y", "ok"), (3, "z", "ok")], "id long, v string, s string")
    got = history.upsert(old, new, "id", F.col("s") == "deleted")
    assert sorted(map(tuple, got.collect())) == [(1, "x", "deleted"), (2, "", "ok"), (3, "z", "ok")]
    filled = history.fill_empty(old, spark.createDataFrame([(2, "n"), (1, "m")], "id long, v string"), "id", ["v"])
    assert {r["id"]: r["v"] for r in filled.collect()} == {1: "x", 2: "n"}


def test_streaks(spark):
    rows = spark.createDataFrame([(1, i, ok) for i, ok in enumerate([0, 0, 1, 0, 0, 0, 0, 0, 1])], "k long, t long, ok int")
    got = [r["streak"] for r in state.failure_streaks(rows, "k", ["t"], F.col("ok") == 0).orderBy("t").collect()]
    assert got == [1, 2, 0, 1, 2, 3, 4, 5, 0]


def test_urls(spark):
    given = ["https://x.com/p?utm_source=x&fbclid=abc&id=10", "HTTPS://WWW.X.com//a//B/#f", None, "mailto:x"]
    df = spark.createDataFrame([(u,) for u in given], "u string")
    assert [r[0] for r in df.select(urls.clean(F.col("u"))).collect()][:2] == ["https://x.com/p?id=10", "https://www.x.com/a/B"]
    pages_ = ["https://x.com/noticia/1", "https://x.com/uploads/a.jpg", "https://x.com/contact/", "https://x.com/um-titulo-bem-longo-de-materia", None, "", "https://x.com/2024/05/01/a"]
    df = spark.createDataFrame([(u,) for u in pages_], "u string")
    assert [r[0] for r in df.select(urls.looks_like_article(F.col("u"))).collect()] == [True, False, False, True, False, False, True]


def test_feeds_and_sitemaps(spark):
    xml = """<rss><item><title><![CDATA[A & b]]></title><link>http://x/1?utm_source=a</link><pubDate>d</pubDate></item><item><title>A2</title><link>http://x/1?utm_source=a</link></item>
    <item><title>No link</title></item><item><title>Guid</title><guid>http://x/2</guid></item></rss>"""
    atom = '<feed><entry><title>T</title><link rel="alternate" href="http://y/1"/><updated>u</updated></entry></feed>'
    df = spark.createDataFrame([("r", xml), ("a", atom), ("n", None), ("e", "")], "feed string, xml string")
    got = sorted((r["feed"], r["title"], r["link"], r["date"]) for r in pages.feed_items(df, "feed", "xml").collect())
    assert got == [("a", "T", "http://y/1", "u"), ("r", "A & b", "http://x/1?utm_source=a", "d"), ("r", "Guid", "http://x/2", "")]
    assert pages.feed_items(df, "feed", "xml", 1).count() == 2
    maps = spark.createDataFrame([("m", "<urlset><url><loc>http://x/a</loc><lastmod>1</lastmod></url><url><loc>http://x/a</loc></url><url><loc>http://x/b.PNG</loc></url></urlset>")], "m string, xml string")
    assert [tuple(r) for r in pages.sitemap_locations(maps, "m", "xml").collect()] == [("m", "http://x/a", "1")]


def test_readers_and_queue(spark, tmp_path):
    (tmp_path / "terms.json").write_text(json.dumps([{"term": "Saúde", "weight": 99}, {"term": "saude", "weight": 3}, {"term": " "}]))
    assert [(r["key"], r["weight"]) for r in tables.read_terms(spark, [str(tmp_path / "terms.json")]).collect()] in ([("saude", 60)], [("saude", 3)])
    (tmp_path / "s.txt").write_text("1) Jornal | https://www.j.com/rss\nhttps://k.com/sitemap.xml\nnothing\nhttps://k.com/sitemap.xml\n")
    assert sorted((r["url"], r["kind"]) for r in tables.read_sources(spark, [str(tmp_path / "s.txt")]).collect()) == [("https://k.com/sitemap.xml", "sitemap"), ("https://www.j.com/rss", "rss")]
    (tmp_path / "a.log").write_text("fine\nERROR x\nfail y\n")
    assert [r["line"] for r in tables.read_log_hits(spark, [str(tmp_path / "a.log")], ("error", "fail")).collect()] == [2, 3]
    new = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1), ("", 1), (None, 1)], "link string, n int")
    inserted, counts = tables.new_candidates(new, spark.createDataFrame([("b",)], "link string"), spark.createDataFrame([("c",)], "link string"))
    assert [tuple(r) for r in inserted.collect()] == [("a", 1)]
    assert {r[0]: r[1] for r in counts.collect()} == {"inserted": 1, "duplicate": 2, "blocked": 1, "no_link": 2}


def test_top_k_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert vectors.cosine_top_k(none, none, "vec_id", "embedding", 5).count() == 0


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    folder = tmp_path / "in"
    folder.mkdir()
    events.repartition(1).write.parquet(str(folder / "x"))
    stream = spark.readStream.schema(events.schema).parquet(str(folder / "*"))
    query = cycles.hourly_counts(stream).writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("hours").agg(F.sum("n")).first()[0] == events.count()
    failed = stream.where("event_type = 'error'")
    query = cycles.cooldowns(failed, limit=2).writeStream.outputMode("update").format("memory").queryName("cool").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r["user_id"]: (r["failures"], r["until"] is not None) for r in spark.table("cool").collect()}
    want = {r["user_id"]: (r["count"], r["count"] >= 2) for r in events.where("event_type = 'error'").groupBy("user_id").count().collect()}
    assert got == want
    run = cycles.run_cycles(stream, lambda b: b.groupBy("event_type").count(), str(tmp_path / "out"), tempfile.mkdtemp(dir=tmp_path))
    run.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("count")).first()[0] == events.count()
