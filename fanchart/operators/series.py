"""Result tables behind charts and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fanchart.grain import Grain
from fanchart.operators.panel import latest_category
from fanchart.schema import PANEL_DEFAULTS, QUANTILES

EXPORT_ORDER = ["date", "sku", "category", "promo_flag", "p10", "p50", "p90"]


def with_category(forecast: DataFrame, history: DataFrame) -> DataFrame:
    """Attach each SKU's latest category to a forecast; a SKU without history gets ``ALL``."""
    joined = forecast.drop("category").join(latest_category(history), "sku", "left")
    return joined.withColumn("category", F.coalesce("category", F.lit(PANEL_DEFAULTS["category"])))


def export_table(forecast: DataFrame, history: DataFrame) -> DataFrame:
    """The forecast with its category, in export column order."""
    full = with_category(forecast, history)
    return full.select(*[c for c in EXPORT_ORDER if c in full.columns])


def first_rows(table: DataFrame, n: int = 200) -> DataFrame:
    """The preview: first ``n`` rows by date and SKU."""
    return table.orderBy("date", "sku").limit(n)


def _long(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, date, series, value) from one column per series."""
    return df.unpivot([key, "date"], columns, "series", "value")


def sku_series(history: DataFrame, forecast: DataFrame) -> DataFrame:
    """History and forecast of every SKU as (sku, date, series, value)."""
    return _long(history, "sku", ["qty"]).unionByName(_long(forecast, "sku", list(QUANTILES)))


def category_series(history: DataFrame, forecast: DataFrame) -> DataFrame:
    """Sums per category and date as (category, date, series, value).

    The series are named ``sum_p10`` and so on: a sum of quantiles is not a quantile of the sum.
    """
    actual = history.groupBy("category", "date").agg(F.sum("qty").alias("qty"))
    future = with_category(forecast, history)
    sums = [F.sum(q).alias(f"sum_{q}") for q in QUANTILES]
    future = future.groupBy("category", "date").agg(*sums)
    names = [f"sum_{q}" for q in QUANTILES]
    return _long(actual, "category", ["qty"]).unionByName(_long(future, "category", names))


def promo_intervals(history: DataFrame, grain: Grain, key: str = "sku") -> DataFrame:
    """Promoted periods of each key as (key, start, end), end exclusive: a whole month or one day."""
    date = F.col("date")
    if grain.name == "monthly":
        start, end = F.trunc(date, "MM"), F.date_add(F.last_day(date), 1)
    else:
        start, end = date, F.date_add(date, 1)
    return history.filter("promo_flag = 1").select(key, start.alias("start"), end.alias("end")).distinct()


def any_promo(history: DataFrame, key: str = "sku") -> DataFrame:
    """Whether a key was ever promoted."""
    return history.groupBy(key).agg((F.max("promo_flag") > 0).alias("any_promo"))
