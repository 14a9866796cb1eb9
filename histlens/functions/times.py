"""Time windows and date columns.  Days are 86,400,000 ms; months are 30 and years 365 days."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
_SPAN = re.compile(r"\s*(\d+)\s*(day|month|year)s?\s*", re.I)
_DAYS = {"day": 1, "month": 30, "year": 365}


def window_start(spec: str, now: datetime) -> datetime:
    """The start of `N days|months|years` before now, or an absolute date; anything else is an error."""
    if m := _SPAN.fullmatch(spec):
        return now - timedelta(days=int(m[1]) * _DAYS[m[2].lower()])
    try:
        found = datetime.fromisoformat(spec.strip())
    except ValueError:
        raise ValueError(f"not a window: {spec!r}; use e.g. '6 months' or '2024-01-31'") from None
    return found if found.tzinfo else found.replace(tzinfo=UTC)


def window_words(spec: str) -> str:
    if m := _SPAN.fullmatch(spec):
        n = int(m[1])
        return f"the last {n} {m[2].lower()}{'s' if n != 1 else ''}"
    return f"since {spec.strip()}"


def as_timestamp(ts: Column) -> Column:
    """Driver tables carry timestamp_ntz; the session zone is UTC."""
    return ts.cast("timestamp")


def millis(ts: Column) -> Column:
    return F.unix_millis(as_timestamp(ts))


def days_between(early: Column, late: Column) -> Column:
    return F.floor((millis(late) - millis(early)) / DAY_MS).cast("long")


def hour_of(ts: Column) -> Column:
    return F.hour(as_timestamp(ts))


def weekday_of(ts: Column) -> Column:
    """Sunday is 0."""
    return F.dayofweek(as_timestamp(ts)) - 1


def iso(ts: Column) -> Column:
    return F.date_format(as_timestamp(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def canonical_utc(text: Column) -> Column:
    """A timestamp of strict ISO text in UTC, with no or three digits of milliseconds; null for other text and impossible dates."""
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{3})?Z\z")
    return F.when(shaped, F.try_to_timestamp(text))


def span_words(days: Column) -> Column:
    plural = lambda n, unit: F.concat(n.cast("string"), F.when(n == 1, f" {unit}").otherwise(f" {unit}s"))
    year, month = F.floor(days / 365).cast("long"), F.floor(days / 30).cast("long")
    return F.when(days <= 0, "a single day").when(days >= 365, plural(year, "year")).when(days >= 30, plural(month, "month")).otherwise(plural(days, "day"))


def quarter_bucket(ts: Column) -> Column:
    t = as_timestamp(ts)
    return F.concat(F.year(t).cast("string"), F.lit("-Q"), F.quarter(t).cast("string"))
