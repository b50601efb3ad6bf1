"""Publication dates are free text: YYYY, YYYY-Mon, YYYY-MM-DD, the head of a range, or 'Unknown'."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def year_token(pub_date: Column) -> Column:
    """What stands before the first '-', whatever it is; null for 'Unknown'."""
    return F.when(pub_date != "Unknown", F.split_part(pub_date, F.lit("-"), F.lit(1)))


def year(pub_date: Column) -> Column:
    """The four digits that a date starts with, as a string, or null."""
    return F.nullif(F.regexp_extract(pub_date, r"^(\d{4})(?!\d)", 1), F.lit(""))


def int_year(pub_date: Column) -> Column:
    return F.try_cast(year_token(pub_date), "int") if hasattr(F, "try_cast") else year_token(pub_date).try_cast("int")


def month_key_compat(pub_date: Column) -> Column:
    """The first seven characters where there are two parts: textual months collide."""
    return F.when((pub_date != "Unknown") & (F.size(F.split(pub_date, "-")) >= 2), F.left(pub_date, F.lit(7)))


def month_key(pub_date: Column) -> Column:
    """yyyy-MM from a numeric or named month, or null."""
    part = F.lower(F.get(F.split(pub_date, "-"), F.lit(1)))
    number = F.when(part.rlike(r"^\d{1,2}$"), part.try_cast("int"))
    named = F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.left(part, F.lit(3))), F.lit(0)).cast("int")
    month = F.coalesce(number, named)
    return F.when(year(pub_date).isNotNull() & month.between(1, 12), F.concat(year(pub_date), F.lit("-"), F.lpad(month.cast("string"), 2, "0")))


def as_date(pub_date: Column) -> Column:
    """The first day that a date can mean: of its day, month or year."""
    key = month_key(pub_date)
    day = F.get(F.split(pub_date, "-"), F.lit(2))
    full = F.when(day.rlike(r"^\d{1,2}$"), F.try_to_date(F.concat(key, F.lit("-"), F.lpad(day, 2, "0")), "yyyy-MM-dd"))
    return F.coalesce(full, F.try_to_date(F.concat(key, F.lit("-01")), "yyyy-MM-dd"), F.try_to_date(F.concat(year(pub_date), F.lit("-01-01")), "yyyy-MM-dd"))


def between(pub_date: Column, first: str, last: str) -> Column:
    """Dates that can lie in a range of yyyy/MM/dd or yyyy-MM-dd days; undated rows don't."""
    days = [F.lit(d.replace("/", "-")).cast("date") for d in (first, last)]
    return F.coalesce(as_date(pub_date).between(*days), F.lit(False))


def bucket(date: Column, window: str) -> Column:
    """The start of a month, year, week, day, or else quarter."""
    return F.date_trunc(window if window in ("month", "year", "week", "day") else "quarter", date).cast("date")


def bucket_label(start: Column, window: str) -> Column:
    if window in ("month", "year"):
        return F.date_format(start, "yyyy-MM" if window == "month" else "yyyy")
    if window in ("week", "day"):
        return F.date_format(start, "yyyy-MM-dd")
    return F.concat(F.date_format(start, "yyyy"), F.lit("Q"), F.quarter(start).cast("string"))
