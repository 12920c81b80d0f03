"""Search results on disk: trial log and best parameters."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from fanchart.sources.sales import write_csv


def write_trials(trials: DataFrame, path: str) -> None:
    """The trial log as CSV."""
    write_csv(trials.orderBy("number"), path)


def write_best_params(spark: SparkSession, params: dict, path: str) -> None:
    """One JSON object with the tuned parameters."""
    spark.createDataFrame([(json.dumps(params),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_best_params(spark: SparkSession, path: str) -> dict | None:
    """Tuned parameters, or None if the file is absent or not a JSON object."""
    try:
        rows = spark.read.text(path, wholetext=True).limit(2).collect()
        loaded = json.loads(rows[0].value) if len(rows) == 1 else None
    except (AnalysisException, ValueError):
        return None
    return loaded if isinstance(loaded, dict) else None
