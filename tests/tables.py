"""Small hand-made panels."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession

PANEL = "date date, sku string, category string, qty double, promo_flag int, oos_flag int"


def month_ends(n: int, year: int = 2020) -> list[date]:
    ends = []
    for i in range(n):
        y, m = year + i // 12, i % 12 + 1
        ends.append((date(y + m // 12, m % 12 + 1, 1)) - timedelta(days=1))
    return ends


def panel(spark: SparkSession, rows) -> DataFrame:
    """Rows of (date, sku, category, qty[, promo_flag[, oos_flag]])."""
    full = [(*row, *([0] * (6 - len(row)))) for row in rows]
    return spark.createDataFrame(full, PANEL)


def series(spark: SparkSession, values: dict[str, list], category: str = "c", start: int = 2020) -> DataFrame:
    """One monthly series per SKU."""
    rows = []
    for sku, qty in values.items():
        rows += [(d, sku, category, None if q is None else float(q)) for d, q in zip(month_ends(len(qty), start), qty)]
    return panel(spark, rows)


def column(df: DataFrame, name: str, *order: str) -> list:
    return [row[name] for row in df.orderBy(*(order or ("sku", "date"))).collect()]
