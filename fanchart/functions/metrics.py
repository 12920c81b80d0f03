"""Error metrics as aggregate columns, usable in any ``groupBy``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The smallest divisor of a ratio, and the score of a model that no fold could evaluate.
FLOOR = 1e-9
UNSCORED = 1e6


def wape(y: Column, forecast: Column) -> Column:
    """Sum of absolute errors over the sum of absolute actuals."""
    return F.sum(F.abs(y - forecast)) / F.greatest(F.sum(F.abs(y)), F.lit(FLOOR))


def smape(y: Column, forecast: Column) -> Column:
    """Symmetric percentage error, between 0 and 2."""
    return F.avg(2 * F.abs(y - forecast) / F.greatest(F.abs(y) + F.abs(forecast), F.lit(FLOOR)))


def pinball(y: Column, quantile: Column, tau: float) -> Column:
    """Quantile loss at ``tau``."""
    error = y - quantile
    return F.avg(F.greatest(tau * error, (tau - 1) * error))


def mase(y: Column, forecast: Column, scale: Column) -> Column:
    """Mean absolute error over the mean in-sample seasonal error of the same SKUs; rows without a scale do not count.

    Averaging before dividing keeps a SKU that never deviated from its season from swamping all others.
    """
    error = F.when(scale.isNotNull(), F.abs(y - forecast))
    return F.avg(error) / F.greatest(F.avg(scale), F.lit(FLOOR))


def quantile_scores(y: str = "qty") -> list[Column]:
    """The scores that need no scale column."""
    return [
        wape(F.col(y), F.col("p50")).alias("wMAPE"),
        smape(F.col(y), F.col("p50")).alias("sMAPE"),
        pinball(F.col(y), F.col("p10"), 0.1).alias("Pinball_p10"),
        pinball(F.col(y), F.col("p50"), 0.5).alias("Pinball_p50"),
        pinball(F.col(y), F.col("p90"), 0.9).alias("Pinball_p90"),
    ]


METRICS = ["wMAPE", "sMAPE", "MASE", "Pinball_p10", "Pinball_p50", "Pinball_p90"]
