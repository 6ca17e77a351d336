"""Discovery and extraction against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators import discover


def test_phases_equal_a_plain_loop(spark):
    rng = random.Random(3)
    phases, seen, want = [], set(), []
    for name, cap in (("a", 5), ("b", 0), ("c", 8), ("d", 100), ("e", 3)):
        rows = [(rng.choice([None, "", *[f"u{i}" for i in range(25)]]), rng.randint(0, 9), i) for i in range(rng.choice([0, 10, 40]))]
        phases.append((name, spark.createDataFrame(rows, "url string, at int, n int"), cap))
        place = 0
        for url in sorted({r[0] for r in rows if r[0]}, key=lambda u, rows=rows: (min((a, n) for x, a, n in rows if x == u), u)):
            if url not in seen and place < cap:
                seen.add(url)
                place += 1
                want.append((url, name, place))
    assert sorted(map(tuple, discover.in_phases(phases, "url", ("at", "n")).collect())) == sorted(want)


@pytest.mark.parametrize("cap", [None, 4])
def test_levels_equal_a_plain_search(spark, cap):
    rng = random.Random(6)
    web = {i: ([rng.choice([None, rng.randrange(90)]) for _ in range(rng.randint(0, 4))], rng.choice([True, True, True, False, None])) for i in range(80)}
    df = spark.createDataFrame([(k, links if k % 5 else links + links, on) for k, (links, on) in web.items()] + [(200, None, True)], "k long, links array<long>, goes boolean")
    seeds = spark.createDataFrame([(1,), (2,), (2,), (None,), (999,), (200,)], "k long")
    seen = {k: 0 for k in sorted({1, 2, 200})[:cap]}
    front = set(seen)
    for level in range(1, 6):
        reached = {x for k in front if web.get(k, ([], True))[1] for x in web.get(k, ([], True))[0] if x in web and x not in seen}
        front = set(sorted(reached)[:cap])
        seen |= {k: level for k in front}
    assert {r["k"]: r["level"] for r in discover.by_levels(df, seeds, "k", "links", 5, goes_on=F.col("goes"), cap=cap).collect()} == seen
    assert discover.by_levels(df, seeds.limit(0), "k", "links", 5).count() == 0


def test_extraction_stops_once_it_is_enough(spark):
    rows = [("x" * 20, "y" * 30, "z"), ("x" * 5, "y" * 12, "z" * 40), ("x" * 5, None, "z" * 5), (None, "", None), ("x", "yy", "zz")]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    broken = F.raise_error(F.lit("worked out in vain")).cast("string")
    got = df.select(discover.extract_until([(c, F.col(c)) for c in "abc"], enough=10)).collect()
    assert [tuple(r[0]) for r in got] == [("a", "x" * 20, 20, 1), ("b", "y" * 12, 12, 2), ("a", "x" * 5, 5, 3), (None, None, 0, 3), ("b", "yy", 2, 3)]
    alone = spark.createDataFrame(rows[:1], "a string, b string, c string")
    assert alone.select(discover.extract_until([("a", F.col("a")), ("never", broken)], enough=10)).first()[0]["strategy"] == "a"
    words = df.select(discover.extract_until([("b", F.col("b")), ("c", F.col("c"))], enough=1, useful=lambda t: F.length(F.replace(t, F.lit("y"), F.lit("")))))
    assert [r[0]["strategy"] for r in words.collect()] == ["c", "c", "c", None, "c"]
