"""Probabilistic demand forecasting (p10/p50/p90) over large sales panels, on Spark."""

from fanchart.grain import DAILY, MONTHLY, Grain

__all__ = ["DAILY", "MONTHLY", "Grain"]
