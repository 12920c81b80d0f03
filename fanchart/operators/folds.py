"""Walk-forward folds over the distinct dates of a panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def rolling_folds(panel: DataFrame, k: int, horizon: int) -> DataFrame:
    """Up to ``k`` folds (fold, train_start, train_end, test_start, test_end), anchors spread evenly over the dates.

    Each fold trains on all dates up to its anchor and tests on the ``horizon`` dates after it. The first anchor is the
    first date. With no more than ``horizon`` dates there is one fold that tests on everything after the first date; fewer
    than three dates raise an error.
    Distinct dates are collected into one array: its length is bounded by the calendar, whatever the panel's size.
    """
    dates = panel.agg(F.array_sort(F.collect_set("date")).alias("d")).select("d", F.size("d").alias("n"))
    room = F.col("n") - horizon - 1
    folds = F.greatest(F.least(F.lit(k), room + 1), F.lit(1))
    guarded = dates.withColumn(
        "room",
        F.when(F.col("n") >= 3, room).otherwise(
            F.raise_error(F.concat(F.lit("walk-forward folds need 3 dates or more, found "), F.col("n"))).cast("int")
        ),
    ).withColumn("folds", folds)
    spread = guarded.select("*", F.explode(F.sequence(F.lit(0), F.col("folds") - 1)).alias("fold"))
    step = F.floor(F.col("fold") * F.col("room") / F.greatest(F.col("folds") - 1, F.lit(1)))
    anchor = F.when(F.col("room") < 0, 0).otherwise(step).cast("int")
    last = F.when(F.col("room") < 0, F.col("n") - 1).otherwise(F.col("anchor") + horizon)
    return spread.withColumn("anchor", anchor).select(
        "fold",
        F.get("d", F.lit(0)).alias("train_start"),
        F.get("d", F.col("anchor")).alias("train_end"),
        F.get("d", F.col("anchor") + 1).alias("test_start"),
        F.get("d", last).alias("test_end"),
    )


def assign_folds(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Each row once per fold it takes part in, with ``part`` train or test.

    The fold table has at most k rows, so it is broadcast; rows outside a fold's range are dropped in the join itself.
    """
    parts = folds.select("fold", "train_end", "test_end")
    in_fold = df["date"] <= parts["test_end"]
    part = F.when(F.col("date") <= F.col("train_end"), "train").otherwise("test")
    return df.join(F.broadcast(parts), in_fold).withColumn("part", part).drop("train_end", "test_end")
