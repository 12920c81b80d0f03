"""Clean-up of forecast values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_half_even(value: Column, digits: int = 2) -> Column:
    """Round by scaling, ties to the even neighbour."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def clip_and_round(value: Column, digits: int = 2) -> Column:
    """Forecasts below zero become zero; the rest is rounded. A missing forecast stays missing."""
    return F.when(value.isNotNull(), round_half_even(F.greatest(value, F.lit(0.0)), digits))


def sorted_quantiles(p10: Column, p50: Column, p90: Column) -> dict[str, Column]:
    """Order three quantiles that may have crossed."""
    ordered = F.array_sort(F.array(p10, p50, p90))
    return {name: F.get(ordered, i) for i, name in enumerate(("p10", "p50", "p90"))}
