"""Ordered folds over one key's history, as windows where the fold has a closed form."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def failure_streaks(df: DataFrame, key: str, order: list[str], failed: Column, limit: int = 5) -> DataFrame:
    """Adds ``streak``, failures since the last success, and ``quarantined``: it is at ``limit`` or more."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = df.withColumn("_f", failed.cast("int")).withColumn("_run", F.sum(1 - F.col("_f")).over(w))
    streak = F.sum("_f").over(Window.partitionBy(key, "_run").orderBy(*order))
    return rows.withColumn("streak", streak).withColumn("quarantined", F.col("streak") >= limit).drop("_f", "_run")


def recurrences(df: DataFrame, key: str, order: list[str], limit: int = 3) -> DataFrame:
    """Adds ``n_so_far`` and ``blocked``: the key came ``limit`` times by then."""
    seen = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("n_so_far", seen).withColumn("blocked", F.col("n_so_far") >= limit)


def _folded(df: DataFrame, key: str, order: list[str], flag: Column, name: str, start: int, step: Callable[[int, list[bool]], tuple[int, list[bool]]]) -> DataFrame:
    """(key, order columns, name): the value that ``step`` makes of the last value and flags, row by row of each key in order.

    Rows come to a task sorted by key and order and are folded as they stream by, so no group is
    held. Rows of a null key are one key's; a null flag is false. Keys are kept as they are.
    """
    rows = df.select(key, *order, F.coalesce(flag, F.lit(False)).alias("_flag")).repartition(key).sortWithinPartitions(key, *order)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_flag") + f", {name} int"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, last = object(), start, []
        for batch in batches:
            out = []
            for k, ok in zip(batch.column(key).to_pylist(), batch.column("_flag").to_pylist()):
                if k != held:
                    held, now, last = k, start, []
                now, last = step(now, [*last, ok])
                out.append(now)
            kept = [c for c in batch.schema.names if c != "_flag"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(out, pa.int32())], [*kept, name])

    return rows.mapInArrow(fold, schema)


def threshold_step(keep: int = 50, least: int = 10) -> Callable[[int, list[bool]], tuple[int, list[bool]]]:
    """The next threshold, and the flags that it needs of the past, from the last threshold and flags."""

    def step(now: int, last: list[bool]) -> tuple[int, list[bool]]:
        last = last[-keep:]
        if len(last) >= least:
            rate = sum(last) / len(last)
            now = max(40, now - 5) if rate < 0.1 else min(90, now + 5) if rate > 0.6 else now
        return now, last

    return step


def interval_step(low: int = 300, high: int = 3600) -> Callable[[int, list[bool]], tuple[int, list[bool]]]:
    """The next waiting time, and the flags that it needs of the past, from the last time and flags."""

    def step(now: int, last: list[bool]) -> tuple[int, list[bool]]:
        last = last[-3:]
        if len(last) == 3:
            now = min(int(now * 1.2), high) if not any(last) else max(int(now * 0.85), low) if sum(last) >= 2 else now
        return now, last

    return step


def adaptive_thresholds(df: DataFrame, key: str, order: list[str], accepted: Column, start: int = 65, keep: int = 50, least: int = 10) -> DataFrame:
    """(key, order columns, threshold): for each key, in order, the threshold after each row: from
    ``start``, 5 down (to 40) where under a tenth of the last ``keep`` rows were accepted, 5 up (to 90) where over
    six tenths were, once there are ``least`` rows (see _folded).
    """

    return _folded(df, key, order, accepted, "threshold", start, threshold_step(keep, least))


def adaptive_intervals(df: DataFrame, key: str, order: list[str], found: Column, start: int = 1800, low: int = 300, high: int = 3600) -> DataFrame:
    """(key, order columns, seconds): each key's waiting time after each cycle, in order: a fifth longer (to ``high``) where
    none of the last three cycles found anything, 15 per cent shorter (to ``low``) where two or more did; whole seconds
    (see _folded). The first two cycles of a key change nothing.
    """

    return _folded(df, key, order, found, "seconds", start, interval_step(low, high))


def cooling(df: DataFrame, key: str, ts: str, order: list[str], failed: Column, seconds: int = 600) -> DataFrame:
    """Adds ``waits``: the row comes less than ``seconds`` after an earlier failure of its key."""
    before = Window.partitionBy(key).orderBy(ts, *order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(failed, F.col(ts))).over(before)
    return df.withColumn("waits", F.coalesce(F.timestamp_diff("SECOND", last, F.col(ts)) < seconds, F.lit(False)))
