"""Training weights: recent rows count more, out-of-stock rows less."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fanchart.functions.dates import periods_between
from fanchart.grain import Grain

# Fixed value: the share of its weight an out-of-stock row loses.
OUT_OF_STOCK_LOSS = 0.9


def half_life(age: Column, periods: int | None) -> Column:
    """1 for the newest date, half of it ``periods`` earlier; 1 everywhere without a half-life."""
    if not periods or periods <= 0:
        return F.lit(1.0)
    return F.pow(F.lit(0.5), age / float(periods))


def add_training_weight(df: DataFrame, grain: Grain, halflife: int | None, column: str = "weight") -> DataFrame:
    """Half-life weight by date times the out-of-stock factor."""
    newest = df.agg(F.max("date").alias("newest")).scalar()
    weight = half_life(periods_between(newest, F.col("date"), grain), halflife)
    if "oos_flag" in df.columns:
        weight = weight * (1.0 - OUT_OF_STOCK_LOSS * F.coalesce("oos_flag", F.lit(0)))
    return df.withColumn(column, weight)
