"""Hours from a first day, dates and periods. Periods are half-open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_time_at(start: Column, hours: Column) -> Column:
    """The minute nearest to `hours` after midnight of start."""
    return F.timestamp_add("MINUTE", F.round(hours * 60).cast("long"), start.cast("timestamp_ntz"))


def parse_date_time(text: Column, start: Column) -> Column:
    """Hours from start of d/m/Y or Y-m-d with an optional H:M[:S]; null if unreadable or before start."""
    t = F.trim(text)
    found = F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in ("d/M/y H:m:s", "d/M/y H:m", "d/M/y", "y-M-d H:m:s", "y-M-d H:m", "y-M-d")])
    h = (F.unix_seconds(found) - F.unix_seconds(start.cast("timestamp"))) / F.lit(3600.0)
    return F.when(h >= 0, h)


def parse_time(text: Column, start: Column | None = None) -> Column:
    """Hours: a plain non-negative number; or a day number from 1 after any word, with hh[:mm] up to 24:00; or a date."""
    t = F.trim(text)
    plain = F.when(t.rlike(r"^\d+(\.\d+)?$"), t.try_cast("double"))
    pattern = r"^(?:[A-Za-z]+\s*)?(\d+)\s+(\d{1,2})(?::(\d{2}))?$|^[A-Za-z]+\s*(\d+)$"
    day = F.coalesce(F.nullif(F.regexp_extract(t, pattern, 1), F.lit("")), F.nullif(F.regexp_extract(t, pattern, 4), F.lit(""))).try_cast("int")
    hh = F.coalesce(F.nullif(F.regexp_extract(t, pattern, 2), F.lit("")).try_cast("int"), F.lit(0))
    mm = F.coalesce(F.nullif(F.regexp_extract(t, pattern, 3), F.lit("")).try_cast("int"), F.lit(0))
    ok = (day >= 1) & (mm < 60) & (hh * 60 + mm <= 1440)
    dayed = F.when(ok, (day - 1) * 24.0 + hh + mm / 60.0)
    found = F.coalesce(plain, dayed)
    return found if start is None else F.coalesce(found, parse_date_time(text, start))


def day_of(hour: Column) -> Column:
    return F.floor(hour / 24).cast("long")


def covered_periods(end_h: Column, period_h: float = 24.0) -> Column:
    """Periods that the horizon reaches into."""
    return F.ceil(end_h / F.lit(period_h) - F.lit(1e-9)).cast("long")


def covered_hours(period: Column, end_h: Column, period_h: float = 24.0) -> Column:
    """Hours of a period within the horizon; null if it isn't covered at all."""
    left = end_h - period * F.lit(period_h)
    return F.when(left > 0, F.least(left, F.lit(period_h)))
