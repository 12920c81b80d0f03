"""Panel features: calendar, own history, promotions, the rest of the category, competitors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fanchart.functions.dates import calendar_columns
from fanchart.functions.frames import lagged, last_known, trailing_mean
from fanchart.grain import COMPETITOR_COLUMNS, Grain
from fanchart.operators.panel import ensure_columns
from fanchart.session import small_side


def add_calendar(df: DataFrame, grain: Grain) -> DataFrame:
    return df.withColumns(calendar_columns(F.col("date"), grain))


def add_target_history(df: DataFrame, grain: Grain) -> DataFrame:
    """Lags and trailing means of the quantity."""
    lags = {f"y_lag{n}": lagged("qty", n) for n in grain.lags}
    means = {f"mean_{n}{grain.suffix}": trailing_mean("qty", n) for n in grain.windows}
    return df.withColumns({**lags, **means})


def add_promo_history(df: DataFrame, grain: Grain) -> DataFrame:
    """Share of promoted rows in trailing windows."""
    return df.withColumns(
        {f"promo_share_{n}{grain.suffix}": trailing_mean("promo_flag", n) for n in grain.promo_windows}
    )


def group_totals(df: DataFrame) -> DataFrame:
    """Quantity and promotion share of each category on each date. A date without any value sums to 0."""
    return df.groupBy("category", "date").agg(
        F.coalesce(F.sum("qty"), F.lit(0.0)).alias("grp_qty"),
        F.avg("promo_flag").alias("grp_promo_share"),
    )


def add_group_totals(df: DataFrame) -> DataFrame:
    """Attach the category's quantity without the row's own.

    The totals are aggregated first (partial sums on the map side), written, and joined back by (category, date). A
    window by category and date would put a date of the default category, that is every SKU, into one task. The totals
    are broadcast if a count shows them to be small; then the panel keeps its partitioning.
    """
    joined = df.join(small_side(group_totals(df)), ["category", "date"], "left")
    return joined.withColumn("grp_qty_excl", F.col("grp_qty") - F.col("qty"))


def add_alone_totals(df: DataFrame) -> DataFrame:
    """What :func:`add_group_totals` gives for a SKU looked at alone: nothing else in its category."""
    return df.withColumns(
        {
            "grp_qty": F.coalesce("qty", F.lit(0.0)),
            "grp_promo_share": F.col("promo_flag").cast("double"),
            "grp_qty_excl": F.coalesce("qty", F.lit(0.0)) - F.col("qty"),
        }
    )


def add_group_history(df: DataFrame, grain: Grain) -> DataFrame:
    """Lags, trailing means and trend of the rest of the category, read in date order per SKU.

    Reading per SKU keeps same-date rows of other SKUs out of a lag, so nothing of the target leaks into it.
    """
    lags = {f"grp_qty_excl_lag{n}": lagged("grp_qty_excl", n) for n in grain.lags}
    means = {f"grp_mean_excl_{n}{grain.suffix}": trailing_mean("grp_qty_excl", n) for n in grain.windows}
    df = df.withColumns({**lags, **means})
    trend = F.col("grp_qty_excl_lag1") - F.col(f"grp_qty_excl_lag{grain.trend_lag}")
    return df.withColumn(grain.trend_column, trend)


def add_competitor_history(df: DataFrame, grain: Grain) -> DataFrame:
    """Lags and trailing means of the competitor columns, in date order per SKU."""
    lags = {f"{c}_lag{n}": lagged(c, n) for c in COMPETITOR_COLUMNS for n in grain.lags}
    means = {
        grain.competitor_window_name(c, n): trailing_mean(c, n)
        for c in COMPETITOR_COLUMNS
        for n in grain.competitor_windows
    }
    return df.withColumns({**lags, **means})


def add_features(panel: DataFrame, grain: Grain, alone: bool = False) -> DataFrame:
    """All features of a panel with one row per (sku, date).

    All frames share one partitioning and order, so the panel is shuffled and sorted once by SKU, after the category
    totals are attached. ``alone`` treats every SKU as if it were the only one.
    """
    df = ensure_columns(panel)
    df = add_alone_totals(df) if alone else add_group_totals(df)
    df = add_target_history(df, grain)
    df = add_promo_history(df, grain)
    df = add_group_history(df, grain)
    df = add_competitor_history(df, grain)
    return add_calendar(df, grain)


def forward_fill(features: DataFrame, columns: list[str]) -> DataFrame:
    """Replace missing values by the SKU's latest earlier one."""
    return features.withColumns({c: last_known(c) for c in columns})


def present_features(df: DataFrame, grain: Grain) -> list[str]:
    """The grain's features that ``df`` has, in the grain's order."""
    return [c for c in grain.feature_columns() if c in df.columns]
