"""Dates of the tag store and of the calendar grid. English names, UTC, the clock is an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STORE_FORMAT = "dd MMM yyyy HH:mm"


def store_text(ts: Column) -> Column:
    return F.date_format(ts, STORE_FORMAT)


def parse_store(text: Column, fallback: Column | None = None) -> Column:
    """Null where the text does not parse, or ``fallback`` if one is given."""
    got = F.try_to_timestamp(text, F.lit(STORE_FORMAT))
    return got if fallback is None else F.coalesce(got, fallback)


def end_of_month(d: Column) -> Column:
    return F.last_day(d)


def end_of_next_month(d: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(d, "month"), 1))


def days_in_month(d: Column) -> Column:
    return F.dayofmonth(F.last_day(d))


def grid_start(d: Column, first_dow: int = 2) -> Column:
    """The first weekday (1: Sunday ... 7: Saturday) on or before the first of the month."""
    m = F.trunc(d, "month")
    return F.date_sub(m, F.pmod(F.dayofweek(m) - first_dow, F.lit(7)).cast("int"))


def grid_days(d: Column, first_dow: int = 2) -> Column:
    """All days shown for the month: from the grid's start to the month's last day."""
    return F.sequence(grid_start(d, first_dow), F.last_day(d), F.expr("interval 1 day"))


def weekday_symbols(first_dow: int = 2) -> Column:
    """The seven short weekday names, beginning with ``first_dow`` (2024-01-07 is a Sunday)."""
    return F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.date_format(F.date_add(F.lit("2024-01-07").cast("date"), F.lit(first_dow - 1) + k), "E"))


def month_names() -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.date_format(F.add_months(F.lit("2024-01-01").cast("date"), k), "MMMM"))
