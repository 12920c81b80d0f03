"""Row frames per SKU.

A panel holds one row per (sku, date), so a SKU's partition is never longer than the calendar and a window by SKU
cannot grow with the data. Windows by category would (every SKU may share one category); none is used.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec, functions as F


def by_sku() -> WindowSpec:
    return Window.partitionBy("sku").orderBy("date")


def lagged(column: str, rows: int) -> Column:
    """The value ``rows`` rows earlier. Gaps in the dates of a SKU are not filled."""
    return F.lag(column, rows).over(by_sku())


def trailing_mean(column: str, rows: int) -> Column:
    """Mean of the ``rows`` rows before this one, NULL unless all of them hold a value."""
    frame = by_sku().rowsBetween(-rows, -1)
    return F.when(F.count(column).over(frame) == rows, F.avg(column).over(frame))


def last_known(column: str) -> Column:
    """This row's value, or the latest earlier one that is not NULL."""
    return F.last(column, ignorenulls=True).over(by_sku().rowsBetween(Window.unboundedPreceding, 0))
