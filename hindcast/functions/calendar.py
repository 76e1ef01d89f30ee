"""Month arithmetic (P1, W9, W26-W29, X4). Months are ``date`` values on the first of the month."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def month_floor(value: Column | str) -> Column:
    """First day of the month; unparseable text becomes NULL instead of failing the job."""
    return F.trunc(as_col(value).try_cast("date"), "month")


def month_number(value: Column | str) -> Column:
    """A running month number, so that month distances are plain subtraction."""
    c = as_col(value)
    return F.year(c) * 12 + F.month(c)


def months_apart(start: Column | str, end: Column | str) -> Column:
    return month_number(end) - month_number(start)


def shift_months(value: Column | str, months: int) -> Column:
    return F.add_months(as_col(value), months)


def period_end(value: Column | str) -> Column:
    return F.last_day(as_col(value))


def available_at(value: Column | str, days: int = 7) -> Column:
    """When a month's figures may be used: some days after the month closes."""
    return F.date_add(period_end(value), days)


def availability_lag_days(available: Column | str, month: Column | str) -> Column:
    return F.datediff(as_col(available), as_col(month))


def cycle_sin(month: Column) -> Column:
    return F.sin(F.lit(2 * pi) * month / 12)


def cycle_cos(month: Column) -> Column:
    return F.cos(F.lit(2 * pi) * month / 12)


def month_sequence(start: Column, end: Column, step: int = 1) -> Column:
    return F.sequence(start, end, F.make_interval(months=F.lit(step)))


def month_count(start: Column, end: Column, step: int = 1) -> Column:
    """How many evaluation months a range holds when only every ``step``-th is used."""
    return F.size(month_sequence(start, end, step))


def month_name(value: Column | str) -> Column:
    return F.date_format(as_col(value), "MMMM")
