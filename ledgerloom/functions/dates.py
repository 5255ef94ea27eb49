"""Date expressions: statement dates, pay days and pay cycles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import DEFAULTS, Params
from .text import Col, as_col, strip

# Day-first formats tried, in order, after the two ISO forms.
DAY_FIRST_FORMATS = (
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    (r"(?i)^\d{1,2} [a-z]{3} \d{4}$", "d MMM yyyy"),
    (r"(?i)^\d{1,2}-[a-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"(?i)^\d{1,2} [a-z]{4,} \d{4}$", "d MMMM yyyy"),
    (r"(?i)^[a-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"(?i)^[a-z]{4,} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "d/M/yy"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
)


def parse_date(c: Col) -> Column:
    """A statement date: ISO in the first ten characters, else day-first, else NULL."""
    text = strip(as_col(c).cast("string"))
    head = F.left(text, F.lit(10))
    day = F.initcap(F.regexp_replace(text, r"(?i)[ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?( ?[ap]m)?$", ""))
    tries = [
        F.when(head.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(head, "yyyy-M-d")),
        F.when(head.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), F.try_to_date(head, "yyyy/M/d")),
    ]
    tries += [F.when(day.rlike(shape), F.try_to_date(day, fmt)) for shape, fmt in DAY_FIRST_FORMATS]
    return F.coalesce(*tries)


def date_reject(d: Col, as_of: dt.date, params: Params = DEFAULTS) -> Column:
    """Reason a date is implausible, else NULL; both bounds are valid dates."""
    day = as_col(d)
    latest = F.lit(as_of + dt.timedelta(days=params.future_grace_days))
    earliest = F.lit(as_of - dt.timedelta(days=params.max_age_days))
    iso = F.date_format(day, "yyyy-MM-dd")
    return F.when(day > latest, F.concat(F.lit("Date "), iso, F.lit(" is in the future"))).when(
        day < earliest,
        F.concat(F.lit("Date "), iso, F.lit(f" is more than {params.max_age_years} years old")),
    )


def month_key(d: Col) -> Column:
    return F.date_format(as_col(d), "yyyy-MM")


def month_start(d: Col) -> Column:
    return F.trunc(as_col(d), "MM")


def _payday_in(first: Column, salary_day: Column) -> Column:
    """Pay day of the month starting at ``first``, clamped to the month length."""
    return F.date_add(first, F.least(salary_day, F.dayofmonth(F.last_day(first))) - 1)


def last_payday(d: Col, salary_day: Col) -> Column:
    day, pay = as_col(d), as_col(salary_day).cast("int")
    here = _payday_in(month_start(day), pay)
    before = _payday_in(F.add_months(month_start(day), -1), pay)
    return F.when(here <= day, here).otherwise(before)


def cycle_position(d: Col, salary_day: Col) -> Column:
    return F.datediff(as_col(d), last_payday(d, salary_day))


def cycle_week(d: Col, salary_day: Col) -> Column:
    return F.least(F.lit(4), F.floor(cycle_position(d, salary_day) / 7).cast("int") + 1)


def next_payday(d: Col, salary_day: Col) -> Column:
    nearest = last_payday(F.date_add(last_payday(d, salary_day), 32), salary_day)
    return F.when(nearest > as_col(d), nearest).otherwise(last_payday(F.date_add(nearest, 32), salary_day))


def dom_distance(a: Col, b: Col) -> Column:
    """Circular distance of two days of the month, on a cycle of 31."""
    gap = F.abs(as_col(a) - as_col(b))
    return F.least(gap, F.lit(31) - gap)


def months_until(target: Col, as_of: Col) -> Column:
    goal, now = as_col(target), as_col(as_of)
    return F.greatest(
        F.lit(1), (F.year(goal) - F.year(now)) * 12 + F.month(goal) - F.month(now)
    )
