"""Ordered gates over extraction results and articles, as reason columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.text import tokens
from tidewire.operators.classify import gate


def _common(status: Column, method: Column) -> list[tuple[Column, str]]:
    return [
        (status == "failed", "extraction_failed"),
        (method.isin("failed", "source_too_short"), "invalid_method"),
        (method == "unresolved", "unresolved"),
        (method == "rss_only", "rss_only"),
    ]


def extraction_gate(status: Column, method: Column, useful: Column, scraped: Column, real: Column, least: int = 500) -> Column:
    """The first reason why an extraction can't be used, or ok; null status and method count as failed."""
    status, method = F.coalesce(status, F.lit("failed")), F.coalesce(method, F.lit("failed"))
    return gate(*_common(status, method), (~real, "no_real_url"), (status == "short_usable", "short_usable"), (useful < least, "too_little_text"), (scraped < least, "too_little_scraped"))


def capture_gate(status: Column, method: Column, useful: Column, least: int = 500) -> Column:
    """As extraction_gate, before a row enters the queue: no test of where the text comes from."""
    status, method = F.coalesce(status, F.lit("failed")), F.coalesce(method, F.lit("failed"))
    return gate(*_common(status, method), (status == "short_usable", "short_usable"), (useful < least, "too_little_text"))


def source_contract(status: Column, text: Column, least: int = 120, present: Column | None = None) -> Column:
    """ok, or why a fetched source is no good: ``invalid`` where there is no result (``present`` is not true), the code of a refused
    request (http_403, http_429) whatever its text, or ``short``: a null text is empty, and white space of any kind at its ends doesn't count."""
    said = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\A\s+", ""), r"(?<!\s)\s+\z", "")
    there = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    refused = F.coalesce(status.isin(403, 429), F.lit(False))
    return F.when(~there, "invalid").when(refused, F.concat(F.lit("http_"), status.cast("string"))).when(F.length(said) < least, "short").otherwise("ok")


def belongs(title: Column, text: Column, least_chars: int = 120) -> Column:
    """ok, or why a text is not about a title: too short, or too few of the title's words (one of up to two, else two)."""
    wanted = tokens(title)
    found = F.size(F.array_intersect(wanted, tokens(text)))
    return gate((F.length(F.coalesce(text, F.lit(""))) < least_chars, "short"), ((F.size(wanted) > 0) & (found < F.when(F.size(wanted) <= 2, 1).otherwise(2)), "other_subject"))


def reasons(*checks: tuple[Column, str]) -> Column:
    """The names of all checks that hold, in order, as an array; a null check does not hold."""
    return F.filter(F.array(*[F.when(F.coalesce(check, F.lit(False)), F.lit(name)) for check, name in checks]), lambda x: x.isNotNull())


def any_term(text: Column, terms: Sequence[str]) -> Column:
    """Whether a text holds any of the terms; null texts hold none."""
    return F.coalesce(F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t)), F.lit(False))
