"""Promotion plans: which future periods of which SKU are promoted."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fanchart.schema import PANEL_DEFAULTS

EVERY_SKU = PANEL_DEFAULTS["sku"]


def one_row_per_key(plan: DataFrame) -> DataFrame:
    """Keep the first plan row of a (date, sku).

    First means lowest ``line``, the row number the plan reader adds. A plan that was not read from a file has no
    order, so its repeated keys count as promoted if any row is.
    """
    first = F.min_by("promo_flag", "line") if "line" in plan.columns else F.max("promo_flag")
    return plan.groupBy("date", "sku").agg(first.cast("int").alias("planned"))


def attach_plan(df: DataFrame, plan: DataFrame | None, column: str = "promo_flag") -> DataFrame:
    """Set ``column`` from the plan by (date, sku); a plan row for SKU ``ALL`` fills in where no exact row exists.

    Without a plan, or where it says nothing, the flag is 0. Exact rows may be many, so that join is left to Spark; the
    general ones are at most one per date, so they are broadcast.
    """
    if plan is None:
        return df.withColumn(column, F.lit(0))
    keyed = one_row_per_key(plan)
    exact = keyed.filter(F.col("sku") != EVERY_SKU)
    general = keyed.filter(F.col("sku") == EVERY_SKU).select("date", F.col("planned").alias("planned_all"))
    joined = df.join(exact, ["date", "sku"], "left").join(F.broadcast(general), "date", "left")
    return joined.withColumn(column, F.coalesce("planned", "planned_all", F.lit(0))).drop("planned", "planned_all")
