"""Helpers for arrays in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body and its lambdas name it."""
    return F.get(F.transform(F.array(value), body), 0)


def first_of_equal(rows: Column) -> Column:
    """Of an array of structs (key, place, value), the values with the first place of each key, in order of place.

    Empty keys equal nothing. Sorted twice, so long arrays take little more than linear time."""

    def firsts(own: Column) -> Column:
        kept = F.transform(own, lambda x, j: F.when((j == 0) | (x["key"] == "") | (F.get(own, j - 1)["key"] != x["key"]), F.struct(x["place"], x["value"])))
        return F.transform(F.array_sort(F.filter(kept, lambda x: x.isNotNull())), lambda x: x["value"])

    return let(F.array_sort(rows), firsts)
