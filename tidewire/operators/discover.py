"""Discovery in phases and levels over a shared set of what was seen, and extraction by strategies until a text is long enough."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.arrays import let
from tidewire.session import saved


def in_phases(phases: Sequence[tuple[str, DataFrame, int]], key: str, order: Sequence[str]) -> DataFrame:
    """(key, phase, place): what each phase takes, in turn: the first rows by ``order`` up to its cap, without keys that it
    or an earlier phase has taken. Rows that a cap leaves out may come in with a later phase. Null and empty keys never count.

    What was taken is never more than the caps together, so it is small beside the candidates."""
    taken = None
    for name, rows, cap in phases:
        own = rows.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").groupBy(key).agg(F.min(F.struct(*order)).alias("_order"))
        if taken is not None:
            own = own.join(taken.select(key), key, "left_anti")
        first = own.orderBy("_order", key).limit(cap)  # the cap is the feature; Spark takes the top of each task first
        place = F.row_number().over(Window.orderBy("_order", key))  # over at most ``cap`` rows
        phase = saved(first.select(key, F.lit(name).alias("phase"), place.alias("place")))
        taken = phase if taken is None else taken.union(phase)
    return taken


def by_levels(pages: DataFrame, seeds: DataFrame, key: str, links: str, depth: int, goes_on: Column | None = None, cap: int | None = None) -> DataFrame:
    """(key, level): the pages that seeds lead to by links within ``depth`` steps, at their least number of steps; seeds have 0.

    ``pages`` has a row for each key, with the array ``links`` of keys; links to keys that it lacks are dropped. Only
    pages for which ``goes_on`` holds are followed; null holds not. With a ``cap``, a level takes the first keys up to it in
    their order, and what it leaves out may come with a later level. Each level is one join with the pages and one anti join with all
    earlier levels, and is written before the next, so the plan stays short; it ends when a level is empty.
    """
    known = pages.select(key, F.array_distinct(F.coalesce(F.col(links), F.array())).alias("_links"), (F.lit(True) if goes_on is None else F.coalesce(goes_on, F.lit(False))).alias("_on"))

    def level(keys: DataFrame, number: int) -> DataFrame:
        found = keys.where(F.col(key).isNotNull()).distinct()
        if cap is not None:
            found = found.orderBy(key).limit(cap)
        return saved(found.select(key, F.lit(number).alias("level")))

    newest = seen = level(seeds.select(key).join(known.select(key), key, "left_semi"), 0)
    for number in range(1, depth + 1):
        reached = known.where("_on").join(newest.select(key), key, "left_semi").select(F.explode("_links").alias(key))
        reached = reached.join(known.select(key), key, "left_semi").join(seen.select(key), key, "left_anti")
        newest = level(reached, number)
        if newest.isEmpty():
            break
        seen = seen.union(newest)
    return seen


def extract_until(strategies: Sequence[tuple[str, Column]], enough: int = 1800, useful: Callable[[Column], Column] = F.length) -> Column:
    """struct(strategy, text, useful, tried): the text with the most useful characters, the earlier of equals.

    Strategies are tried in order until one gives ``enough``; the others are then not worked out. Null texts give none. Where none gives
    a character, strategy and text are null.
    """
    nothing = F.struct(F.lit(None).cast("string").alias("strategy"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("useful"), F.lit(0).alias("tried"))

    def better(name: str, text: Column, number: int) -> Callable[[Column], Column]:
        return lambda best: improved(best, name, text, number)

    def improved(best: Column, name: str, text: Column, number: int) -> Column:
        def compare(t: Column) -> Column:
            n = F.coalesce(useful(t), F.lit(0))
            wins = n > best["useful"]
            return F.struct(
                F.when(wins, name).otherwise(best["strategy"]).alias("strategy"), F.when(wins, t).otherwise(best["text"]).alias("text"), F.greatest(n, best["useful"]).alias("useful"), F.lit(number).alias("tried")
            )

        return F.when(best["useful"] >= enough, best).otherwise(let(text, compare))

    best = nothing
    for number, (name, text) in enumerate(strategies, 1):
        best = let(best, better(name, text, number))
    return best
