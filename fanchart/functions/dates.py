"""Date parsing and calendar columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from fanchart.grain import Grain

# Text formats a date column may have. ISO comes first, so day and month of ISO dates never swap.
ISO_FORMATS = ("yyyy-M-d",)
DAY_FIRST_FORMATS = ("yyyy-M-d", "d.M.yyyy", "d/M/yyyy", "d-M-yyyy")
MONTH_FIRST_FORMATS = ("yyyy-M-d", "M.d.yyyy", "M/d/yyyy", "M-d-yyyy")


def parse_date(column: Column, formats: tuple[str, ...] = ISO_FORMATS) -> Column:
    """Parse text with the first format that fits; text that fits none becomes NULL."""
    return F.to_date(F.coalesce(*[F.try_to_timestamp(column, F.lit(f)) for f in formats]))


def snap(date: Column, grain: Grain) -> Column:
    """Move a date to the end of its period."""
    return F.last_day(date) if grain.name == "monthly" else date


def step_date(date: Column, steps: Column | int, grain: Grain) -> Column:
    """The period ``steps`` after ``date``; monthly periods are month ends."""
    if grain.name == "monthly":
        return F.last_day(F.add_months(date, steps))
    return F.date_add(date, steps)


def periods_between(later: Column, earlier: Column, grain: Grain) -> Column:
    """Whole periods from ``earlier`` to ``later``."""
    if grain.name == "monthly":
        return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)
    return F.date_diff(later, earlier)


def lookback_cutoff(last: Column, months: int, grain: Grain) -> Column:
    """First date kept by a lookback of ``months``; a daily month counts 30 days."""
    if grain.name == "monthly":
        return F.add_months(last, -months)
    return F.date_sub(last, months * 30)


def calendar_columns(date: Column, grain: Grain) -> dict[str, Column]:
    """The calendar features of a grain."""
    turn = 2 * math.pi
    month = F.month(date)
    weekday = F.weekday(date)
    known = {
        "month": month,
        "month_sin": F.sin(F.lit(turn) * month / 12.0),
        "month_cos": F.cos(F.lit(turn) * month / 12.0),
        "quarter": F.quarter(date),
        "dow": weekday,
        "dom": F.dayofmonth(date),
        "week": F.weekofyear(date),
        "dow_sin": F.sin(F.lit(turn) * weekday / 7.0),
        "dow_cos": F.cos(F.lit(turn) * weekday / 7.0),
    }
    return {name: known[name] for name in grain.calendar}
