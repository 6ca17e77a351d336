"""Changes applied to tables, against plain passes over the log; replayed batches and interrupted writes."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidewire.operators import changes
from tidewire.sources.snapshots import SnapshotTable


def log_rows(n, keys, seed=4):
    rng = random.Random(seed)
    return [(rng.choice(keys), i // 2, rng.choice(["delete", "discard", "publish", "reactivate", "reactivate", "delete", "seen", None])) for i in range(n)]


@pytest.mark.parametrize("automaton", [changes.LINKS, changes.STORIES])
@pytest.mark.parametrize("bucket", [None, 7, 1])
def test_fold_equals_a_plain_pass(spark, automaton, bucket):
    rows = log_rows(600, [1, 1, 1, 2, 3, None, *range(10, 60)])
    old = [(2, "published"), (3, "deleted"), (99, "discarded"), (None, "deleted"), (5, "what")]
    states = dict(old) | {5: automaton.states[0]}
    for key, _, action in sorted(rows, key=lambda r: (r[1], r[2] or "")):
        state = states.get(key, automaton.states[0])
        states[key] = automaton.moves.get(action, {}).get(state, state)
    df, start = spark.createDataFrame(rows, "k long, seq long, action string"), spark.createDataFrame(old, "k long, state string")
    got = changes.fold_states(df, automaton, "k", ("seq",), bucket=bucket and F.floor(F.col("seq") / bucket), start=start).collect()
    assert {r["k"]: r["state"] for r in got} == states and len(got) == len(states)
    assert {r["k"]: r["changes"] for r in got} == {k: sum(x[0] == k for x in rows) for k in states}
    # replaying on the result of the first half gives the same as the whole
    first, second = df.where("seq < 150"), df.where("seq >= 150")
    half = changes.fold_states(first, automaton, "k", ("seq",), start=start)
    assert {r["k"]: r["state"] for r in changes.fold_states(second, automaton, "k", ("seq",), start=half).collect()} == states


def test_fold_edges(spark):
    none = spark.createDataFrame([], "k long, seq long, action string")
    assert changes.fold_states(none, changes.LINKS, "k", ("seq",)).count() == 0
    begun = time.perf_counter()
    hot = spark.range(400_000).select(F.lit(1).alias("k"), F.col("id").alias("seq"), F.when(F.col("id") % 2 == 0, "delete").otherwise("reactivate").alias("action"))
    assert tuple(changes.fold_states(hot, changes.LINKS, "k", ("seq",), bucket=F.floor(F.col("seq") / 1000)).first()) == (1, "free", 400_000)
    assert time.perf_counter() - begun < 60


def test_merge_equals_a_plain_pass(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(30)]), i, rng.choice([None, i]), rng.choice([None, f"n{i}"]), rng.random() < 0.2) for i in range(200)]
    table = {k: {"a": k, "b": None, "c": "kept"} for k in range(15)}
    want, gone = {k: dict(v) for k, v in table.items()}, set()
    for k, _, a, b, dead in rows:
        if k is not None:
            row = want.setdefault(k, {"a": None, "b": None, "c": None})
            row.update({n: v for n, v in (("a", a), ("b", b)) if v is not None})
            (gone.add if dead else gone.discard)(k)
    base = spark.createDataFrame([(k, v["a"], v["b"], v["c"]) for k, v in table.items()] + [(None, 1, "x", "null")], "k long, a long, b string, c string")
    log = spark.createDataFrame(rows, "k long, seq long, a long, b string, dead boolean")
    got = changes.merge_log(base, log, "k", ("seq",), ("a", "b"), deleted=F.col("dead"))
    assert got.columns == base.columns
    assert {r["k"]: (r["a"], r["b"], r["c"]) for r in got.collect()} == {k: (v["a"], v["b"], v["c"]) for k, v in want.items() if k not in gone} | {None: (1, "x", "null")}
    assert changes.merge_log(base, log.limit(0), "k", ("seq",), ("a", "b")).count() == 16


def test_versions_backfill_and_reset(spark):
    old = spark.createDataFrame([("a", 1), ("a", 4), ("b", None)], "k string, version int")
    new = spark.createDataFrame([("a", 2), ("a", 1), ("b", 1), ("c", 1), (None, 1)], "k string, at int")
    got = {(r["k"], r["at"]): r["version"] for r in changes.append_versions(old, new, "k", ("at",)).collect()}
    assert got == {("a", 1): 5, ("a", 2): 6, ("b", 1): 1, ("c", 1): 1, (None, 1): 1}
    table = spark.createDataFrame([(1, None, "t"), (2, " ", None), (3, "x", "u")], "id long, a string, b string")
    filled = changes.backfill(table, {"a": F.lit("d"), "n": F.col("id") * 2}, {"m": "int"})
    assert [tuple(r) for r in filled.orderBy("id").collect()] == [(1, "d", "t", None, 2), (2, "d", None, None, 4), (3, "x", "u", None, 6)]
    assert changes.backfill(filled, {"a": F.lit("z"), "n": F.lit(0)}, {"m": "int"}).collect() == filled.collect()
    assert [r["b"] for r in changes.reset_rows(table, F.col("b") == "t", {"b": F.lit("")}).orderBy("id").collect()] == ["", None, "u"]


def test_snapshots_survive_replays_and_crashes(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"), "k long, a string")
    add = lambda k, a: lambda old: old.unionByName(spark.createDataFrame([(k, a)], "k long, a string"))
    rows = lambda: sorted(map(tuple, SnapshotTable(spark, str(tmp_path / "t"), "k long, a string").read().collect()))
    assert rows() == [] and table.apply(0, add(1, "x")) and rows() == [(1, "x")]
    assert not table.apply(0, add(9, "again")) and rows() == [(1, "x")]
    publish, table._publish = table._publish, lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        table.apply(1, add(2, "half"))
    assert rows() == [(1, "x")] and (tmp_path / "t" / "version-2").exists()
    table._publish = publish
    assert table.apply(1, add(2, "y")) and rows() == [(1, "x"), (2, "y")]
    for batch in range(2, 6):
        assert table.apply(batch, add(batch + 1, "z"))
    assert len(rows()) == 6 and sorted(x.name for x in (tmp_path / "t").iterdir()) == ["pointers", "version-5", "version-6"]


def test_a_stream_of_changes_goes_in_once(spark, tmp_path):
    """A stream that is started again from an older checkpoint sends its batches again; they change nothing."""
    import shutil

    schema = "k long, state string"
    table = SnapshotTable(spark, str(tmp_path / "states"), schema)
    (tmp_path / "in").mkdir()

    def run(checkpoint):
        def batch(df, number):
            table.apply(number, lambda old: changes.fold_states(df, changes.LINKS, "k", ("seq",), start=old).select("k", "state"))

        stream = spark.readStream.schema("k long, seq long, action string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(120)

    for i, action in enumerate(("delete", "reactivate", "publish")):
        (tmp_path / "in" / f"{i}.json").write_text(f'{{"k": 1, "seq": {i}, "action": "{action}"}}\n')
        time.sleep(0.02)
    run(str(tmp_path / "cp"))
    assert [tuple(r) for r in table.read().collect()] == [(1, "published")] and table.state() == {"version": 3, "batch": 2}
    shutil.rmtree(tmp_path / "cp")
    run(str(tmp_path / "cp"))
    assert table.state() == {"version": 3, "batch": 2}
