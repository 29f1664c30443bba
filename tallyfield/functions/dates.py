"""Dates in the formats that sources write."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("dd/MM/yyyy", "dd-MM-yyyy", "yyyy-MM-dd", "yyyy/MM/dd")


def parsed_date(text: Column, formats=FORMATS) -> Column:
    """The first format that fits; a day and month alone, and anything else, give null."""
    return F.coalesce(*[F.try_to_date(text, f) for f in formats])


def resolved_day_month(text: Column, today: Column) -> Column:
    """A date from ``dd/MM``: this year's, unless that is over 180 days off, then next or last year's."""
    day, month = F.regexp_extract(text, r"^(\d{1,2})/(\d{1,2})$", 1), F.regexp_extract(text, r"^(\d{1,2})/(\d{1,2})$", 2)
    of = lambda shift: F.try_to_date(F.concat_ws("-", (F.year(today) + shift).cast("string"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")
    gap = F.date_diff(of(0), today)
    return F.when(gap < -180, of(1)).when(gap > 180, of(-1)).otherwise(of(0))


def any_date(text: Column, today: Column) -> Column:
    """A full date if there is one, else a day and month resolved near ``today``."""
    return F.coalesce(parsed_date(text), resolved_day_month(text, today))


def mixed_sort_key(text: Column) -> Column:
    """Text by which dates of several formats sort: ``dd/MM`` and ``dd/MM/yy(yy)`` begin with their year, if any.

    ISO dates and whatever else there is stay; null is empty.
    """
    slashed = r"^(\d{2})/(\d{2})(?:/(\d{2,4}))?$"
    turned = F.concat_ws("-", *[F.regexp_extract(text, slashed, i) for i in (3, 2, 1)])
    return F.when(text.rlike(slashed), turned).otherwise(F.coalesce(text, F.lit("")))


def reformatted(text: Column, style: str) -> Column:
    """``dd/MM``, ``dd-MM-yyyy`` or ``iso`` from ragged text: its first two short numbers and a year 2020..2030."""
    numbers = F.regexp_extract_all(text, F.lit(r"\b(\d{1,2})\b"), F.lit(1))
    year = F.get(F.regexp_extract_all(text, F.lit(r"\b(20(?:2\d|30))\b"), F.lit(1)), F.lit(0))
    day, month = (F.lpad(F.get(numbers, F.lit(i)), 2, "0") for i in (0, 1))
    if style == "dd/MM":
        return F.when(day.isNotNull() & month.isNotNull(), F.concat(day, F.lit("/"), month))
    complete = day.isNotNull() & month.isNotNull() & year.isNotNull()
    parts = (day, month, year) if style == "dd-MM-yyyy" else (year, month, day)
    return F.when(complete, F.concat_ws("-", *parts))


def kickoff(text: Column) -> Column:
    """A timestamp from ISO text with zone; the years that stand for unknown give null."""
    found = F.try_to_timestamp(text)
    return F.when(~F.year(found).isin(1, 1901), found)


def within_days(a: Column, b: Column, days: int = 1) -> Column:
    return F.abs(F.date_diff(a, b)) <= days


def countdown(day: Column, today: Column) -> Column:
    """today, tomorrow, in N days; null for the past."""
    gap = F.date_diff(day, today)
    return F.when(gap == 0, "today").when(gap == 1, "tomorrow").when(gap > 1, F.concat(F.lit("in "), gap.cast("string"), F.lit(" days")))
