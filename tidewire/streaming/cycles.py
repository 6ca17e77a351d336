"""The collection cycle as Structured Streaming: micro-batches, hourly windows, per-key cooldowns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def hourly_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", late: str = "10 minutes") -> DataFrame:
    """Counts by hour and key; rows later than ``late`` behind the newest are dropped by the watermark."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.window("_ts", "1 hour").alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), key, "n")


def cooldowns(failures: DataFrame, key: str = "user_id", ts: str = "ts", limit: int = 5, seconds: int = 600) -> DataFrame:
    """(key, failures, until): state per key; from ``limit`` failures on, each sets the key's cooldown to ``seconds`` after it."""
    name = failures.schema[key].dataType.simpleString()

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, until = state.get if state.exists else (0, None)
        for batch in batches:
            for at in batch["at"].sort_values():
                n += 1
                if n >= limit:
                    until = max(until or 0, int(at.timestamp()) + seconds)
        state.update((n, until))
        yield pd.DataFrame({key: [group[0]], "failures": [n], "until": pd.array([until], dtype="Int64")})

    return (
        failures.select(key, F.col(ts).cast("timestamp").alias("at"))
        .groupBy(key)
        .applyInPandasWithState(step, f"{key} {name}, failures long, until long", "n long, until long", "update", GroupStateTimeout.NoTimeout)
    )


def first_seen(rows: DataFrame, key: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key once while its state lasts: keys are kept until the watermark passes them."""
    return rows.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).dropDuplicatesWithinWatermark([key]).drop("_ts")


def run_cycles(rows: DataFrame, cycle: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, once: bool = True):
    """Applies a batch operator to every micro-batch and writes a folder for each, so a replayed batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        cycle(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="120 seconds")).start()
