"""Plans built from the columns that a table has."""

from pyspark.sql import functions as F

from tidewire.operators import schemas


def test_aliases_and_flags(spark):
    df = spark.createDataFrame([(1, None, " b ", None, "0"), (2, "a", "b", "Done", "1"), (3, " ", None, "OPEN", None), (4, "x", "y", None, "sim")], "id long, `first.one` string, second string, status string, hidden string")
    assert [r[0] for r in df.select(schemas.first_filled(df, ["none", "first.one", "second"])).collect()] == ["b", "a", None, "x"]
    assert [r[0] for r in df.select(schemas.first_filled(df, ["none"], "long")).collect()] == [None] * 4
    active = lambda **o: [r["id"] for r in df.where(schemas.is_active(df, **o)).collect()]
    assert active(flags=["hidden", "gone"], truthy=["1", "sim"]) == [1, 3]
    assert active(flags=[], truthy=[], closed=["done"]) == [1, 3, 4]
    assert active(flags=["gone"], truthy=["1"], closed=["done"], status="state", needed=["first.one", "gone"]) == [2, 4]


def test_completed_structs(spark):
    defaults = {"title": "none", "tags": ["a"], "meta": {"n": 1, "deep": {"on": True, "x": 0.5}}, "list": [], "new": 7}
    full = "title string, tags array<string>, meta struct<n:int,deep:struct<on:boolean,extra:int>,gone:int>, outside int, list array<string>"
    rows = [("t", ["b"], (None, (False, 1), 3), 1, ["z"]), (None, None, None, None, None), ("", [], (5, None, None), 2, [])]
    got = [r.asDict(True) for r in schemas.complete_rows(spark.createDataFrame(rows, full), defaults).collect()]
    assert got == [
        {"title": "t", "tags": ["b"], "meta": {"n": 1, "deep": {"on": False, "x": 0.5}}, "list": ["z"], "new": 7},
        {"title": "none", "tags": ["a"], "meta": {"n": 1, "deep": {"on": True, "x": 0.5}}, "list": [], "new": 7},
        {"title": "", "tags": [], "meta": {"n": 5, "deep": {"on": True, "x": 0.5}}, "list": [], "new": 7},
    ]
    bare = schemas.complete_rows(spark.createDataFrame([(1,)], "other int"), defaults)
    assert bare.first().asDict(True) == got[1] and bare.columns == list(defaults)
    odd = schemas.complete_rows(spark.createDataFrame([("x", "8")], "meta string, new string"), defaults).first().asDict(True)
    assert odd["meta"] == got[1]["meta"] and odd["new"] == 8


def test_queues_of_any_columns(spark):
    long = "x" * 600
    rows = [("https://www.A.com/p/uma-nota_nova.html?x=1", "", long, "i.jpg", "Geral"), ("https://b.com/x/", "Título", "curto", None, "Fonte B"), (None, None, None, None, None), ("u", "Traceback here", long, None, "c"), ("http://c.com/a", "Charge do dia", "", "", None), (None, "Sem link", None, None, None)]
    df = spark.createDataFrame(rows, "url string, titulo string, dossie string, thumb string, fonte_nome string")
    got = [(r["queue_title"], r["queue_source"], r["queue_state"], r["queue_score"], r["queue_rank"]) for r in schemas.queue_rows(df).collect()]
    assert got == [("uma nota nova", "a.com", "ok", 100, 6000), ("Título", "Fonte B", "short", 70, 1000), ("Charge do dia", "c.com", "pending", 35, -3000), ("Sem link", None, "pending", 35, 0)]
    assert schemas.queue_rows(df).columns[:5] == df.columns
    only = schemas.queue_rows(spark.createDataFrame([(1, "sim")], "id long, oculta string").withColumn("link_origem", F.lit("http://x")))
    assert only.count() == 0
