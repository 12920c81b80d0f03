"""A made-up monthly panel for demonstrations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Level, trend origin (months after the start), trend per month and promoted months of the demo SKUs.
DEMO_ITEMS = [
    ("A", 90.0, 36, 0.3, [3, 9]),
    ("B", 35.0, 18, 0.5, [11, 12]),
    ("C", 60.0, 36, 0.3, []),
]
ITEM_SCHEMA = "sku string, base double, origin int, slope double, promo_months array<int>"
DEMO_START, DEMO_END = "2019-01-31", "2024-12-31"
YEAR_SWING, HALF_YEAR_SWING, PROMO_BOOST, NOISE = 12.0, 6.0, 10.0, 5.0
# Items whose months one task makes.
ITEMS_A_TASK = 10_000


def demo_items(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEMO_ITEMS, ITEM_SCHEMA)


def normal_noise(item: str, at: str, seed: int) -> Column:
    """A standard normal number per item and place: two even ones from a digest, turned by Box and Muller's method."""
    digest = F.md5(F.concat_ws(":", F.col(item), F.col(at).cast("string"), F.lit(str(seed))).cast("binary"))
    even = [(F.conv(F.substring(digest, first, 12), 16, 10).cast("double") + 0.5) / 16.0**12 for first in (1, 13)]
    return F.sqrt(-2 * F.log(even[0])) * F.cos(2 * math.pi * even[1])


def synthetic_panel(
    items: DataFrame, start: str = DEMO_START, end: str = DEMO_END, noise: float = NOISE, seed: int = 7
) -> DataFrame:
    """One row per item and month end: level, linear trend, two seasonal waves, promotion boost and noise, at least 0.

    The noise follows from item, month and seed alone, so partitions cannot change it. A row of items becomes a row per
    month, so few files or row groups of items are much work: the items are counted and dealt out before that.
    """
    first, last = F.last_day(F.lit(start).cast("date")), F.last_day(F.lit(end).cast("date"))
    months = (F.year(last) - F.year(first)) * 12 + F.month(last) - F.month(first)
    calendar = items.sparkSession.range(1).select(F.explode(F.sequence(F.lit(0), months)).alias("i"))
    month = F.month("date")
    wave = YEAR_SWING * F.sin(2 * math.pi * month / 12) + HALF_YEAR_SWING * F.cos(2 * math.pi * month / 6)
    calendar = calendar.withColumn("date", F.last_day(F.add_months(first, F.col("i")))).withColumn("wave", wave)
    dealt = items.repartition(max(1, -(-items.count() // ITEMS_A_TASK)))
    grid = dealt.crossJoin(F.broadcast(calendar))
    promo = F.array_contains("promo_months", month).cast("int")
    level = F.col("base") + (F.col("i") - F.col("origin")) * F.col("slope") + F.col("wave") + PROMO_BOOST * promo
    if noise:
        level = level + noise * normal_noise("sku", "i", seed)
    return grid.select(
        "date", "sku", F.round(F.greatest(level, F.lit(0.0)), 2).alias("qty"), promo.alias("promo_flag")
    )
