"""Dates of schedules: text forms, working days and weeks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date_swiss(c: Column) -> Column:
    """dd/mm/yyyy or dd.mm.yy with trailing letters or stars; two-digit years below 50 are 20yy. Bad text is null."""
    text = F.regexp_replace(F.trim(c), r"[A-Za-z*\s]+$", "")
    pattern = r"^(\d{1,2})[./](\d{1,2})[./](\d{4}|\d{2})$"
    d, m, y = (F.regexp_extract(text, pattern, k) for k in (1, 2, 3))
    year = F.when(F.length(y) == 2, F.when(y.try_cast("int") < 50, F.concat(F.lit("20"), y)).otherwise(F.concat(F.lit("19"), y))).otherwise(y)
    return F.when(text.rlike(pattern), F.try_to_date(F.concat_ws("-", year, F.lpad(m, 2, F.lit("0")), F.lpad(d, 2, F.lit("0"))), "yyyy-MM-dd"))


def ensure_weekday(d: Column) -> Column:
    """Saturdays and Sundays move to Monday."""
    return F.date_add(d, F.when(F.dayofweek(d) == 7, 2).when(F.dayofweek(d) == 1, 1).otherwise(0))


def add_weeks_workday(d: Column, weeks: Column) -> Column:
    """Whole weeks later; a weekend goes back to Friday for negative weeks, else on to Monday."""
    moved = F.date_add(d, weeks * 7)
    back = F.date_sub(moved, F.when(F.dayofweek(moved) == 7, 1).when(F.dayofweek(moved) == 1, 2).otherwise(0))
    return F.when(weeks < 0, back).otherwise(ensure_weekday(moved))


def weeks_between(a: Column, b: Column) -> Column:
    """Weeks between two dates without sign, one place."""
    return F.round(F.abs(F.datediff(b, a)) / 7.0, 1)
