"""Streams whose state expires: restarts, late rows, and what is left of the state."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidewire.operators import state
from tidewire.streaming import expiring

START = dt.datetime(2024, 1, 1)
SCHEMA = "host string, ts timestamp, status int"


@pytest.fixture
def stream(spark, tmp_path):
    """Runs a stream over all files so far, from its checkpoint, and gives the rows that it has written in all."""
    (tmp_path / "in").mkdir()
    count = [0]

    def run(made, *batches):
        for rows in batches:
            text = "\n".join(json.dumps({"host": h, "ts": (START + dt.timedelta(seconds=s)).isoformat(), "status": x}) for h, s, x in rows)
            path = tmp_path / "in" / f"{count[0]:03}.json"
            path.write_text(text)
            import os

            os.utime(path, (1_700_000_000 + count[0] * 10,) * 2)
            count[0] += 1
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        query = made(source).writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(150)
        left = query.lastProgress["stateOperators"][0]["numRowsTotal"] if query.lastProgress else None
        rows = spark.read.json(str(tmp_path / "out")).collect()
        return [r.asDict() for r in rows], left

    return run


def seconds(at):
    return round((dt.datetime.fromisoformat(at.split(".")[0].rstrip("Z")).replace(tzinfo=None) - START).total_seconds())


def test_cooldowns_end_by_timer_and_survive_a_restart(stream):
    made = lambda rows: expiring.expiring_cooldowns(rows, "host", "ts", F.col("status") == 429, seconds=180, late="60 seconds")
    verdicts = lambda rows: sorted((r["key"], seconds(r["at"]), r["verdict"]) for r in rows)
    rows, _ = stream(made, [("a", 0, 429), ("b", 1, 200)], [("a", 100, 200), ("a", 120, 429), ("b", 110, None)])
    assert verdicts(rows) == [("a", 0, "go"), ("a", 100, "wait"), ("a", 120, "wait"), ("b", 1, "go"), ("b", 110, "go")]
    # a restart knows the cooldown; a row behind the watermark (60 s before the newest) is dropped
    rows, _ = stream(made, [("a", 299, 200), ("a", 30, 429)], [("c", 300, 429)])
    assert ("a", 299, "wait") in verdicts(rows) and ("a", 30, "wait") not in verdicts(rows)
    # the watermark passes 300: the state of a goes, that of c stays
    rows, left = stream(made, [("b", 400, 200)], [("b", 410, 200), ("a", 405, 200)])
    assert ("a", 300, "over") in verdicts(rows) and ("a", 405, "go") in verdicts(rows)
    assert sum(v == "over" for _, _, v in verdicts(rows)) == 1 and left is not None


def test_folds_equal_the_batch_fold_and_forget_idle_keys(stream):
    made = lambda rows: expiring.expiring_fold(rows, "host", "ts", F.col("status") == 200, 65, state.threshold_step(keep=5, least=3), idle=1000, late="60 seconds")
    flags = [1, 1, 1, 0, 0, 0, 0, 0, 1, 1]
    step, now, last, want = state.threshold_step(keep=5, least=3), 65, [], []
    for i, f in enumerate(flags):
        now, last = step(now, [*last, bool(f)])
        want.append((i * 10, now))
    rows, _ = stream(made, [("a", i * 10, 200 if f else 500) for i, f in enumerate(flags[:4])], [("a", i * 10, 200 if f else 500) for i, f in reversed(list(enumerate(flags))) if i >= 4])
    assert sorted((seconds(r["at"]), r["value"]) for r in rows) == want and want[-1][1] != 65
    rows, _ = stream(made, [("b", 2000, 200)], [("b", 2010, 200)], [("a", 2020, 200)])
    assert {r["value"] for r in rows if r["key"] == "a" and seconds(r["at"]) == 2020} == {65}
