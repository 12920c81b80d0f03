"""SKU text clean-up."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Texts that stand for a missing SKU, and what replaces them.
MISSING_SKU_TEXTS = ("", "nan", "NaN", "None")
MISSING_SKU = "NA"


def normalise_sku(column: Column) -> Column:
    """Trim white space, drop the ``.0`` a numeric SKU picks up, and mark missing values."""
    text = F.regexp_replace(column.cast("string"), r"^\s+|\s+$", "")
    text = F.regexp_replace(text, r"\.0$", "")
    return F.when(text.isNull() | text.isin(*MISSING_SKU_TEXTS), MISSING_SKU).otherwise(text)
