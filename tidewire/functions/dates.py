"""Time windows with an explicit now."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def age_hours(ts: str, now: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, {ts}, timestamp_ntz'{now}') / 3600000000D")


def window_verdict(ts: str, now: str, hours: float, ahead_minutes: int = 10) -> Column:
    """Struct (ok, reason, age): no date, a date too far ahead and one too old fail, in this order; bounds are inside."""
    age = F.coalesce(age_hours(ts, now), F.lit(999999.0))
    reason = F.when(F.col(ts).isNull(), "no_date").when(age < -ahead_minutes / 60, "future").when(age > hours, "too_old").otherwise("in_window")
    return F.struct((reason == "in_window").alias("ok"), reason.alias("reason"), age.alias("age"))


def lenient_window(ts: str, now: str, hours: float) -> Column:
    """No date passes; no check of dates ahead."""
    return F.coalesce(age_hours(ts, now) <= hours, F.lit(True))


def age_priority(ts: str, now: str, hours: float) -> Column:
    age = age_hours(ts, now)
    return F.when(age <= 1, 3).when(age <= 2, 2).when(age <= hours, 1).otherwise(0)


def date_in_text(text: Column) -> Column:
    """The first day, month and year in a text that stand with a time (``02/05/2026 às 17h54``), else the first without one, at midnight.

    Where the first with a time is no real date, that without one counts. Entities for blanks and slashes are read."""
    said = F.regexp_replace(F.regexp_replace(F.lower(text), "&nbsp;|&#160;|&#xa0;| ", " "), "&#47;|&#x2f;", "/")
    day = r"\b(\d{1,2})/(\d{1,2})/(\d{4})"
    timed, plain = day + r"\s*(?:às|as|-)?\s*(\d{1,2})[:h](\d{2})\b", day + r"\b"
    part = lambda pattern, k: F.regexp_extract(said, pattern, k).try_cast("int")
    made = lambda p, hour, minute: F.try_make_timestamp_ntz(part(p, 3), part(p, 2), part(p, 1), hour, minute, F.lit(0))
    return F.coalesce(made(timed, part(timed, 4), part(timed, 5)), made(plain, F.lit(0), F.lit(0)))
