"""State of streams that expires: cooldowns that end by a timer, and folds that forget a key that has been idle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Timers need the RocksDB state store; streams that are started after this use it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _events(rows: DataFrame, key: str, ts: str, flag: Column, late: str) -> DataFrame:
    use_state_store(rows.sparkSession)
    timed = rows.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("at"), F.coalesce(flag, F.lit(False)).alias("flag"))
    return timed.where("at is not null").withWatermark("at", late)


def _in_order(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's rows of one micro-batch in order of time; equal times with failures, or hits, last."""
    return pd.concat(list(batches)).sort_values(["at", "flag"], kind="stable")


def _millis(at: pd.Timestamp) -> int:
    return int(at.value // 1_000_000)


class _Cooldown(StatefulProcessor):
    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        until = before = self.until.get()[0] if self.until.exists() else None
        out = []
        for row in _in_order(rows).itertuples():
            at = _millis(row.at)
            out.append((key[0], row.at, "wait" if until is not None and at < until else "go"))
            if row.flag:
                until = max(until or 0, at + self.seconds * 1000)
        if until != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.until.update((until,))
            self.handle.registerTimer(until)
        yield pd.DataFrame(out, columns=["key", "at", "verdict"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.until.clear()
        yield pd.DataFrame([(key[0], pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms"), "over")], columns=["key", "at", "verdict"])

    def close(self) -> None:
        pass


def expiring_cooldowns(rows: DataFrame, key: str, ts: str, failed: Column, seconds: int = 180, late: str = "1 minute") -> DataFrame:
    """(key, at, verdict): for each row of a stream whether its key may ``go`` or has to ``wait``, as a failure of it was less than
    ``seconds`` before; and ``over`` once the watermark has passed the end of a cooldown, when the key's state goes.

    Keys without a failure have no state. Rows behind the watermark are dropped by Spark; others that come late count as they come.
    """
    own = _events(rows, key, ts, failed, late)
    kind = own.schema["key"].dataType.simpleString()
    return own.groupBy("key").transformWithStateInPandas(_Cooldown(seconds), f"key {kind}, at timestamp, verdict string", "append", "EventTime")


class _Fold(StatefulProcessor):
    def __init__(self, start: int, step: Callable, idle: int):
        self.start, self.step, self.idle = start, step, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "now long, last string, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, last, due = self.state.get() if self.state.exists() else (self.start, "", None)
        flags, out, newest = [x == "1" for x in last], [], due or 0
        for row in _in_order(rows).itertuples():
            now, flags = self.step(int(now), [*flags, bool(row.flag)])
            out.append((key[0], row.at, now))
            newest = max(newest, _millis(row.at) + self.idle * 1000)
        if newest != due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(newest)
        self.state.update((now, "".join("01"[f] for f in flags), newest))
        yield pd.DataFrame(out, columns=["key", "at", "value"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def expiring_fold(rows: DataFrame, key: str, ts: str, flag: Column, start: int, step: Callable[[int, list[bool]], tuple[int, list[bool]]], idle: int = 86_400, late: str = "1 minute") -> DataFrame:
    """(key, at, value): the value that ``step`` (see operators.state) makes after each row of a stream of the last value and
    flags; a key that has no rows for ``idle`` seconds is forgotten, once the watermark has passed them, and begins anew from ``start``."""
    own = _events(rows, key, ts, flag, late)
    kind = own.schema["key"].dataType.simpleString()
    return own.groupBy("key").transformWithStateInPandas(_Fold(start, step, idle), f"key {kind}, at timestamp, value long", "append", "EventTime")
