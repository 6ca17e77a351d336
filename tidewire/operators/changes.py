"""Changes applied to tables in plain Spark: logs folded per key in order, merges, appended versions, backfills."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Automaton:
    """States, the first of which a key without a row has, and for each action where it leads from some of them; from the others it changes nothing."""

    states: tuple[str, ...]
    moves: Mapping[str, Mapping[str, str]]

    def effects(self) -> dict[str, list[int]]:
        """For each action, the number of the state that each state leads to."""
        number = {s: i for i, s in enumerate(self.states)}
        return {action: [number[to.get(s, s)] for s in self.states] for action, to in self.moves.items()}


#: Whether a link may come again: it is blocked by the first reason, and an editor's own block is all that reactivation takes back.
LINKS = Automaton(
    ("free", "deleted", "discarded", "published"),
    {"delete": {"free": "deleted"}, "discard": {"free": "discarded"}, "publish": {"free": "published"}, "reactivate": {"deleted": "free"}},
)
#: A story's status is that of the last change, but what is published is no longer deleted or discarded.
STORIES = Automaton(
    ("new", "deleted", "discarded", "published"),
    {"delete": {"new": "deleted", "discarded": "deleted"}, "discard": {"new": "discarded", "deleted": "discarded"}, "publish": {"new": "published"}, "reactivate": {"deleted": "new", "discarded": "new"}},
)


def fold_states(log: DataFrame, automaton: Automaton, key: str, order: Sequence[str], action: str = "action", bucket: Column | None = None, start: DataFrame | None = None) -> DataFrame:
    """(key, state, changes): the state of each key of ``log`` or ``start`` after its actions in ``order``.

    ``changes`` counts the log's rows. Actions are functions of a few states, so those of a ``bucket`` of the order (a column that
    does not fall as the order grows, such as the day of a time) are put together on their own, and then the buckets of
    a key: a key with very many changes is never one task's. ``start`` (key, state) holds earlier states; a key
    that it lacks starts in the first. Unknown and null actions, and unknown states of ``start``, count as no change and as the
    first state. Rows with equal order fields go by action.
    """
    effects, same = automaton.effects(), list(range(len(automaton.states)))
    table = F.create_map(*[x for a, e in effects.items() for x in (F.lit(a), F.array(*map(F.lit, e)))])
    identity = F.array(*map(F.lit, same))
    then = lambda done, next_: F.transform(done, lambda s: F.get(next_, s))
    rows = log.select(F.col(key).alias("_key"), (bucket if bucket is not None else F.lit(0)).alias("_bucket"), F.struct(*order, F.col(action).alias("_action")).alias("_row"))
    steps = F.transform(F.array_sort(F.collect_list("_row")), lambda r: F.coalesce(F.try_element_at(table, r["_action"]), identity))
    parts = rows.groupBy("_key", "_bucket").agg(F.aggregate(steps, identity, then).alias("_effect"), F.count("*").alias("_n"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("_bucket", "_effect"))), lambda r: r["_effect"])
    folded = parts.groupBy("_key").agg(F.aggregate(whole, identity, then).alias("_effect"), F.sum("_n").alias("changes"))
    number = F.lit(0)
    if start is not None:
        own = start.select(F.col(key).alias("_start"), (F.array_position(F.array(*map(F.lit, automaton.states)), F.col("state")) - 1).cast("int").alias("_from"))
        folded = folded.join(own, F.col("_key").eqNullSafe(F.col("_start")), "full")
        number = F.greatest(F.coalesce("_from", F.lit(0)), F.lit(0))
    state = F.get(F.array(*map(F.lit, automaton.states)), F.get(F.coalesce("_effect", identity), number))
    key_ = F.coalesce("_key", "_start") if start is not None else F.col("_key")
    return folded.select(key_.alias(key), state.alias("state"), F.coalesce("changes", F.lit(0)).alias("changes"))


def merge_log(table: DataFrame, log: DataFrame, key: str, order: Sequence[str], columns: Sequence[str], deleted: Column | None = None) -> DataFrame:
    """``table`` (one row a key) after the log's changes: of each of ``columns`` the last value that is not null wins over the
    row's own, keys that it lacks come in with what they have, and a key whose last change is ``deleted`` goes.

    All is partial aggregation, so a key with very many changes costs one row a task. Null keys are left as they are.
    """
    at = F.struct(*order)
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_{c}") for c in columns]
    gone = F.coalesce(F.max_by(F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False), at), F.lit(False))
    changes = log.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(*last, gone.alias("_gone"))
    joined = table.join(changes, F.col(key) == F.col("_key"), "full").where(~F.coalesce("_gone", F.lit(False)))
    values = {c: F.coalesce(f"_{c}", c) for c in columns} | {key: F.coalesce(key, "_key")}
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in table.columns])


def append_versions(old: DataFrame, new: DataFrame, key: str, order: Sequence[str], version: str = "version") -> DataFrame:
    """``new`` rows with the next versions of their keys, in order; ``old`` has (key, version). Null versions count as none."""
    latest = old.groupBy(F.col(key).alias("_key")).agg(F.coalesce(F.max(version), F.lit(0)).alias("_last"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    joined = new.join(latest, F.col(key).eqNullSafe(F.col("_key")), "left")
    return joined.withColumn(version, F.coalesce("_last", F.lit(0)) + place).drop("_key", "_last")


def backfill(table: DataFrame, values: Mapping[str, Column], kinds: Mapping[str, str] | None = None) -> DataFrame:
    """``table`` with empty fields (null, or blank text) of ``values`` filled; columns that it lacks are added, with the type in
    ``kinds`` or that of their value. Filled fields stay, so doing it again changes nothing."""
    out = table
    for c, kind in (kinds or {}).items():
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast(kind))
    for c, value in values.items():
        if c not in out.columns:
            out = out.withColumn(c, value)
        else:
            empty = F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
            out = out.withColumn(c, F.when(empty, value).otherwise(F.col(c)))
    return out


def reset_rows(table: DataFrame, where: Column, values: Mapping[str, Column]) -> DataFrame:
    """``table`` with the fields of ``values`` set in the rows for which ``where`` holds; null holds not."""
    hit = F.coalesce(where, F.lit(False))
    return table.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})
