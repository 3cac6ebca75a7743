"""Grains, shifts and period bounds."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = {"year": 12, "quarter": 3, "month": 1}
DAYS = {"week": 7, "day": 1}


def truncate(c: Column, grain: str) -> Column:
    """The start of the period; a date for grains of a day or more. Weeks begin on Monday."""
    out = F.date_trunc(grain, c)
    return out if grain == "hour" else out.cast("date")


def shift(c: Column, n: int, grain: str, hours: bool = False) -> Column:
    """n periods later (earlier if n is negative); months end where the month does."""
    if grain == "hour":
        return c + F.make_interval(hours=F.lit(n))
    moved = F.add_months(c, n * MONTHS[grain]) if grain in MONTHS else F.date_add(c, n * DAYS[grain])
    if not hours:
        return moved
    return (moved.cast("timestamp_ntz") + (c - F.date_trunc("day", c))).cast("timestamp_ntz")


def parsed(value: str) -> datetime:
    return datetime.fromisoformat(value)


def start_of(value: datetime, grain: str) -> datetime:
    day = datetime(value.year, value.month, value.day)
    match grain:
        case "year":
            return datetime(value.year, 1, 1)
        case "quarter":
            return datetime(value.year, 3 * ((value.month - 1) // 3) + 1, 1)
        case "month":
            return datetime(value.year, value.month, 1)
        case "week":
            return day - timedelta(days=day.weekday())
        case "day":
            return day
    return day + timedelta(hours=value.hour)


def moved(value: datetime, n: int, grain: str) -> datetime:
    """A literal n periods later; a day that the month lacks becomes its last."""
    if grain in MONTHS:
        total = value.year * 12 + value.month - 1 + n * MONTHS[grain]
        year, month = divmod(total, 12)
        last = (date(year + (month == 11), (month + 1) % 12 + 1, 1) - timedelta(days=1)).day
        return value.replace(year=year, month=month + 1, day=min(value.day, last))
    return value + (timedelta(hours=n) if grain == "hour" else timedelta(days=n * DAYS[grain]))
