"""A sales panel over the TPC-H-like tables: SKU = brand/type, category = type, quantity = shipped quantity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fanchart.grain import Grain
from fanchart.operators.panel import normalise
from fanchart.session import cut_lineage

# The discount and tax from which a line counts as promoted by the seller and by a competitor.
PROMO_DISCOUNT = 0.085
COMPETITOR_TAX = 0.06


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with the SKU and category of their part; only the columns in use are read.

    The parts side is left to Spark: broadcast if small, otherwise a sort-merge join whose skewed parts are split.
    """
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.concat("p_brand", F.lit("/"), "p_type").alias("sku"),
        F.col("p_type").alias("category"),
        "p_retailprice",
    )
    return lines.join(parts, "l_partkey")


def daily_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unaggregated sales rows as a raw feed has them: several rows per SKU and day."""
    return sales_lines(spark, sf_dir).select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_shipdate").cast("date").alias("date"),
        "sku",
        "category",
        F.col("l_quantity").alias("qty"),
        "l_extendedprice",
        (F.col("l_discount") >= PROMO_DISCOUNT).cast("int").alias("promo_flag"),
    )


def sales_panel(spark: SparkSession, sf_dir: str, grain: Grain) -> DataFrame:
    """The full panel, one row per (sku, date). Partial sums on the map side come before the only shuffle."""
    day = F.col("l_shipdate").cast("date")
    quantity = F.sum("l_quantity")
    rows = F.count("*")
    panel = (
        sales_lines(spark, sf_dir)
        .groupBy("sku", "category", (F.last_day(day) if grain.name == "monthly" else day).alias("date"))
        .agg(
            quantity.alias("qty"),
            (5 * F.count_if(F.col("l_discount") >= PROMO_DISCOUNT) >= rows).cast("int").alias("promo_flag"),
            (2 * F.count_if(F.col("l_returnflag") == "R") > rows).cast("int").alias("oos_flag"),
            F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")) / F.avg("p_retailprice"), 6).alias(
                "comp_price_index"
            ),
            F.round(F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(0.0)) / quantity + 0.5, 6)
            .alias("comp_qty_index"),
            (3 * F.count_if(F.col("l_tax") >= COMPETITOR_TAX) >= rows).cast("int").alias("comp_promo_flag"),
        )
    )
    return normalise(panel, grain)


def written_panel(spark: SparkSession, sf_dir: str, grain: Grain) -> DataFrame:
    """The panel, written once: for queries that read it several times, so that the order lines are scanned once."""
    return cut_lineage(sales_panel(spark, sf_dir, grain))


def last_year_plan(panel: DataFrame) -> DataFrame:
    """A promotion plan made from the panel: each SKU repeats last year's promotions, December is promoted for all."""
    again = F.last_day(F.add_months("date", 12))
    exact = panel.select(again.alias("date"), "sku", "category", "promo_flag")
    december = panel.select(again.alias("date")).filter(F.month("date") == 12).distinct()
    general = december.select(
        "date", F.lit("ALL").alias("sku"), F.lit("ALL").alias("category"), F.lit(1).alias("promo_flag")
    )
    return exact.unionByName(general)
