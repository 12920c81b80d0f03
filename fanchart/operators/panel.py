"""From raw rows to a clean panel: defaults, dates, lookback, outlier caps, day-to-month roll-up."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from fanchart.functions.dates import ISO_FORMATS, lookback_cutoff, parse_date, snap
from fanchart.functions.quantiles import exact_percentile
from fanchart.functions.text import normalise_sku
from fanchart.grain import Grain
from fanchart.schema import PANEL_COLUMNS, PANEL_DEFAULTS, PANEL_TYPES, require_columns
from fanchart.session import small_side


class DuplicateKeyError(ValueError):
    """A panel holds more than one row for a (sku, date)."""


def ensure_columns(df: DataFrame) -> DataFrame:
    """Rename ``SKU`` to ``sku`` and add the columns the input lacks, with their defaults."""
    if "sku" not in df.columns and "SKU" in df.columns:
        df = df.withColumnRenamed("SKU", "sku")
    absent = {
        name: F.lit(default).cast(PANEL_TYPES[name])
        for name, default in PANEL_DEFAULTS.items()
        if name not in df.columns
    }
    return df.withColumns(absent) if absent else df


def period(df: DataFrame, grain: Grain, formats: tuple[str, ...] = ISO_FORMATS) -> Column:
    """The column ``date`` at the end of its period; text is parsed first."""
    date = F.col("date")
    if dict(df.dtypes)["date"] == "string":
        date = parse_date(date, formats)
    return snap(date.cast("date"), grain)


def normalise(df: DataFrame, grain: Grain, formats: tuple[str, ...] = ISO_FORMATS) -> DataFrame:
    """A raw sales table as a panel: required columns checked, defaults, SKU as clean text, dates, column order."""
    df = ensure_columns(require_columns(df, ["qty", "date"], "sales"))
    typed = {name: F.col(name).cast(kind) for name, kind in PANEL_TYPES.items()}
    typed["date"] = period(df, grain, formats)
    typed["sku"] = normalise_sku(F.col("sku"))
    typed["category"] = F.coalesce(typed["category"], F.lit(PANEL_DEFAULTS["category"]))
    typed["qty"] = F.nanvl(typed["qty"], F.lit(None).cast("double"))
    return df.select(*[typed[name].alias(name) for name in PANEL_COLUMNS])


def require_unique_key(panel: DataFrame) -> DataFrame:
    """Raise if a (sku, date) occurs twice. Windows by SKU rely on it: it bounds a SKU by the calendar."""
    repeated = panel.groupBy("sku", "date").count().filter("count > 1").orderBy("sku", "date").limit(5).collect()
    if repeated:
        raise DuplicateKeyError("panel has repeated (sku, date): " + ", ".join(f"{r.sku} {r.date}" for r in repeated))
    return panel


def keep_lookback(panel: DataFrame, months: int | None, grain: Grain) -> DataFrame:
    """Keep the last ``months`` before the newest date, as a scalar subquery that reaches the scan as a filter."""
    if months is None:
        return panel
    newest = panel.agg(F.max("date").alias("newest")).scalar()
    return panel.filter(F.col("date") >= lookback_cutoff(newest, months, grain))


def drop_incomplete(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop rows with a NULL in any of ``columns`` (default: in any column).

    One IS NOT NULL per column: Spark pushes each down on its own. ``na.drop`` makes a single predicate over all
    columns, from which the optimizer derives a constraint per subset of renamed columns.
    """
    return df.filter(reduce(and_, [F.col(c).isNotNull() for c in columns or df.columns]))


def winsorise(df: DataFrame, p: float = 0.99, key: str = "sku", value: str = "qty") -> DataFrame:
    """Cap ``value`` at its ``p`` percentile per ``key``; only the upper side is touched."""
    caps = small_side(exact_percentile(df, [key], value, {"cap": p}))
    capped = F.when(F.col(value).isNotNull(), F.least(F.col(value), F.col("cap")))
    return df.join(caps, key, "left").withColumn(value, capped).drop("cap")


def monthly_rollup(daily: DataFrame, p: float = 0.99) -> DataFrame:
    """Cap daily quantities, then sum days to months.

    ``promo_share`` is the share of the month's days with a promotion, ``sale_days`` the number of rows that sold
    anything. The category and a month-level promotion flag are kept so that the result is a complete panel.
    """
    capped = winsorise(ensure_columns(daily), p)
    month = F.last_day("date")
    summed = capped.groupBy("sku", month.alias("date")).agg(
        F.sum("qty").alias("qty"),
        F.count_if(F.col("qty") > 0).alias("sale_days"),
        F.sum("promo_flag").alias("promo_days"),
        # Two categories on the last day: the larger one, so that the choice is stable.
        F.max_by("category", F.struct("date", "category")).alias("category"),
    )
    share = F.least(F.greatest(F.col("promo_days") / F.dayofmonth("date"), F.lit(0.0)), F.lit(1.0))
    return summed.select(
        "date",
        "sku",
        "category",
        "qty",
        share.alias("promo_share"),
        "sale_days",
        (F.col("promo_days") > 0).cast("int").alias("promo_flag"),
    )


def panel_extent(panel: DataFrame) -> DataFrame:
    """Number of distinct months and SKUs."""
    return panel.agg(
        F.count_distinct(F.last_day("date")).alias("months"),
        F.count_distinct("sku").alias("skus"),
    )


def latest_category(panel: DataFrame) -> DataFrame:
    """One category per SKU, the newest one."""
    return panel.groupBy("sku").agg(F.max_by("category", "date").alias("category"))


def first_category(panel: DataFrame) -> DataFrame:
    """One category per SKU, the oldest one."""
    return panel.groupBy("sku").agg(F.min_by("category", "date").alias("category"))


def distinct_values(panel: DataFrame, column: str) -> DataFrame:
    """The sorted choices of a selector, such as all SKUs or all categories."""
    return panel.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)
