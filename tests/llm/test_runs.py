"""Periodic runs against all lags of all words."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from tidewire.llm import periodic_runs


def brute(words, times=4, least=6):
    out = []
    for q in range(1, len(words) // times + 1):
        k = q
        while k < len(words):
            end = k
            while end < len(words) and words[end] == words[end - q]:
                end += 1
            start, length = k - q, end - k + q
            own = words[start:end]
            smaller = any(own[r:] == own[:-r] for r in range(1, q))
            if end > k and length >= max(least, times * q) and not smaller:
                out.append((start, length, q))
            k = end + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def told(words, runs):
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def samples(n):
    rng = random.Random(3)
    for _ in range(n):
        words = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 70))]
        if rng.random() < 0.7 and len(words) > 8:
            p, a = rng.randint(1, len(words) // 3), rng.randrange(len(words))
            words = [w if i < a else words[(a + (i - a) % p) % len(words)] for i, w in enumerate(words)]
        yield words[:7] * 9 if rng.random() < 0.2 else words


def test_runs_equal_all_lags(make):
    rows = [(i, " \t\n\x0b".join(["", *words, ""]) if i % 2 else " ".join(words)) for i, words in enumerate(samples(1500))]
    for options in ({}, {"times": 5, "least": 11}, {"part": 100}):
        for r in periodic_runs.find_runs(make(rows, "id long, text string"), **options).collect():
            words = r["text"].split()
            want = brute(words, options.get("times", 4), options.get("least", 6))
            assert [tuple(x) for x in r["runs"]] == want, words
            assert r["n_words"] == len(words) and r["collapsed"] == told(words, want)


def test_runs_edges(make):
    block = "a b c d " * 4
    rows = [(1, None), (2, ""), (None, " \n "), (4, "w"), (5, block), (5, block), (6, "x " * 6), (7, "x " * 5), (8, "É\u2028É " * 4 + "\x1cé " * 6), (9, "y " * 300_000)]
    got = periodic_runs.find_runs(make(rows, "id long, text string", extra=("runs", "collapsed", "n", "key"))).collect()
    assert [tuple(map(tuple, r["runs"])) for r in got] == [(), (), (), (), ((0, 16, 4),), ((0, 16, 4),), ((0, 6, 1),), (), ((4, 6, 1),), ((0, 300_000, 1),)]
    assert [r["collapsed"] for r in got][-1] == "y" and got[0]["n"] == "x" and got[5]["collapsed"] == "a b c d"
    assert periodic_runs.find_runs(make([], "id long, text string")).count() == 0


def test_strongest_run_is_an_exact_fraction(spark):
    runs = [(5, 9, 2), (3, 18, 4), (1, 27, 6), (0, 12, 3)]
    df = spark.createDataFrame([(runs,), ([],), (None,)], "r array<struct<start:long,length:long,period:long>>")
    assert [r[0] and tuple(r[0]) for r in df.select(periodic_runs.strongest(F.col("r"))).collect()] == [(5, 9, 2), None, None]


def test_long_texts_take_little_more_than_linear_time():
    begun = time.perf_counter()
    start, length, period = periodic_runs.periodic_stretches(np.tile(np.r_[np.zeros(999, dtype=int), 1], 400))
    assert len(start) == 401 and (int(start[1]), int(length[1]), int(period[1])) == (0, 400_000, 1000)
    assert time.perf_counter() - begun < 20
