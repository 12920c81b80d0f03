"""Column types and defaults of the tables the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

# What a panel column holds when the input lacks it.
PANEL_DEFAULTS = {
    "sku": "ALL",
    "category": "ALL",
    "promo_flag": 0,
    "oos_flag": 0,
    "comp_price_index": 1.0,
    "comp_qty_index": 1.0,
    "comp_promo_flag": 0,
}

PANEL_TYPES = {
    "date": T.DateType(),
    "sku": T.StringType(),
    "category": T.StringType(),
    "qty": T.DoubleType(),
    "promo_flag": T.IntegerType(),
    "oos_flag": T.IntegerType(),
    "comp_price_index": T.DoubleType(),
    "comp_qty_index": T.DoubleType(),
    "comp_promo_flag": T.IntegerType(),
}

PANEL_COLUMNS = list(PANEL_TYPES)

PLAN_TYPES = {
    "date": T.DateType(),
    "sku": T.StringType(),
    "category": T.StringType(),
    "promo_flag": T.IntegerType(),
}

FORECAST_TYPES = {
    "date": T.DateType(),
    "sku": T.StringType(),
    "promo_flag": T.IntegerType(),
    "p10": T.DoubleType(),
    "p50": T.DoubleType(),
    "p90": T.DoubleType(),
}

QUANTILES = {"p10": 0.1, "p50": 0.5, "p90": 0.9}


class MissingColumnError(ValueError):
    """A table lacks a column that has no default."""


def require_columns(df: DataFrame, columns: list[str], table: str) -> DataFrame:
    """Return ``df`` unchanged, or raise naming the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumnError(f"{table} must contain column(s) {', '.join(missing)}")
    return df
