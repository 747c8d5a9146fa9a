"""Date arithmetic as column expressions: availability, business days, quarters, staleness."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Market open, UTC. Weekends are skipped, exchange holidays are not.
MARKET_OPEN = "INTERVAL '13:30' HOUR TO MINUTE"


def knowledge_from(base_date: Column, lag_days: Column | int) -> Column:
    """When a value dated `base_date` could first be known: lag, next weekday, market open."""
    candidate = F.date_add(base_date, lag_days)
    weekday = F.weekday(candidate)
    roll = F.when(weekday == 5, 2).when(weekday == 6, 1).otherwise(0)
    return F.date_add(candidate, roll).cast("timestamp") + F.expr(MARKET_OPEN)


def _weekdays_up_to(day: Column) -> Column:
    # Counted from Monday 1969-12-29, three days before the epoch.
    offset = F.unix_date(day) + 3
    full_weeks = F.floor(offset / 7)
    return full_weeks * 5 + F.least(offset - full_weeks * 7 + 1, F.lit(5))


def business_days_between(start: Column, end: Column) -> Column:
    """Weekdays in (start, end]; 0 when end <= start. Closed form, no date sequence."""
    span = _weekdays_up_to(end) - _weekdays_up_to(start)
    return F.when(end <= start, F.lit(0)).otherwise(span).cast("bigint")


def quarter_starts(start: Column, end: Column) -> Column:
    """Array of the quarter-start dates inside [start, end]."""
    floor = F.trunc(start, "quarter")
    first = F.when(floor < start, F.add_months(floor, 3)).otherwise(floor)
    return F.when(
        first <= end, F.sequence(first, end, F.expr("INTERVAL 3 MONTHS"))
    ).otherwise(F.array().cast("array<date>"))


def quarter_start_dates(start: dt.date, end: dt.date) -> list[dt.date]:
    """The same calendar as a Python list, for use as an argument of the panel operators."""
    first = start.year * 4 + (start.month - 1) // 3
    days = (
        dt.date(index // 4, index % 4 * 3 + 1, 1)
        for index in range(first, end.year * 4 + (end.month - 1) // 3 + 1)
    )
    return [day for day in days if start <= day <= end]


def staleness_days(as_of: Column, seen_at: Column) -> Column:
    """Elapsed time in fractional 24-hour days."""
    return (F.unix_micros(as_of) - F.unix_micros(seen_at)) / F.lit(86_400_000_000.0)


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole 24-hour days elapsed; not a difference of calendar dates."""
    return F.floor(staleness_days(later, earlier)).cast("bigint")


def local_date(iso_timestamp: Column) -> Column:
    """Calendar date written in an ISO timestamp, whatever its UTC offset."""
    return F.to_date(F.substring(iso_timestamp, 1, 10))


def is_single_quarter(period_start: Column, period_end: Column) -> Column:
    """True for a duration of one quarter, as opposed to year-to-date, annual or instant."""
    return period_start.isNotNull() & F.datediff(period_end, period_start).between(80, 100)
