"""Types of articles, dates in prose, pictures' addresses and snippets."""

import datetime as dt

from pyspark.sql import functions as F

from tidewire.functions.dates import date_in_text
from tidewire.operators import clean, types
from tidewire.operators.scoring import image_url_score


def test_dates_in_prose(spark):
    rows = {
        "em 02/05/2026 às 17h54 e 01/01/2020": dt.datetime(2026, 5, 2, 17, 54), "01/01/2020 e 2/5/2026 - 7:05": dt.datetime(2026, 5, 2, 7, 5), "31/02/2026 10:00 e 03/04/2026": None,
        "02/05/2026": dt.datetime(2026, 5, 2), "02/05/2026 25:00": dt.datetime(2026, 5, 2), "102/05/2026": None, "2&#47;5&#47;2026&nbsp;AS&nbsp;9:30": dt.datetime(2026, 5, 2, 9, 30),
        "2/5/20261": None, "99/99/2026 e 02/05/2026 8:00": dt.datetime(2026, 5, 2, 8, 0), "": None, None: None,
    }
    got = spark.createDataFrame([(t,) for t in rows], "t string").select(date_in_text(F.col("t"))).collect()
    assert [r[0] for r in got] == list(rows.values())


def test_snippets_and_pictures(spark):
    rows = {"Leia também: x": True, "LEIA  TAMBEM": True, "Releia mais": False, "Você pode gostar": True, "Anúncios": True, "O anúncio": False, "": False, None: False}
    assert [r[0] for r in spark.createDataFrame([(t,) for t in rows], "t string").select(clean.is_snippet(F.col("t"))).collect()] == list(rows.values())
    urls = {"http://x/Foto-1200.JPG": 12 + 5 + 2, "http://x/logo.png": 8 - 15, "http://x/a.jpeg": 12, "http://cdn.x/wp-content/uploads/full.webp": 10 + 15 + 2 - 15, "": 0, None: 0}
    assert [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(image_url_score(F.col("u"))).collect()] == list(urls.values())


def test_types_by_channel_clues_and_fallback(spark):
    rules = types.TypeRules(("court", "health"), {"sport": ("preview", "result", "hard_news")}, {"opinion": "editorial"}, {"city": "local"}, default="other")
    hits = [(1, "result"), (1, "court"), (2, "preview"), (2, "result"), (3, "court"), (4, "court"), (4, "health"), (4, "health2"), (5, "health"), (5, "court"), (5, "health3"), (None, "court")]
    hits = spark.createDataFrame([(i, p, f"t{n}", 1) for n, (i, p) in enumerate(hits)] + [(5, "health", "more", 1)], "id long, part string, term string, weight int")
    rows = [(1, "sport"), (2, "sport"), (3, "opinion"), (4, "x"), (5, None), (6, "sport"), (7, "city"), (8, "x"), (None, "x"), (4, "city")]
    got = types.article_types(spark.createDataFrame(rows, "id long, channel string"), hits, rules).select("id", "channel", "type").collect()
    want = ["result", "preview", "editorial", "court", "health", "hard_news", "local", "other", "court", "court"]
    assert sorted(map(tuple, got), key=str) == sorted(((*r, t) for r, t in zip(rows, want)), key=str)
    assert types.article_types(spark.createDataFrame(rows, "id long, channel string").limit(0), hits.limit(0), rules).count() == 0
