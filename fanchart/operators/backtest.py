"""Walk-forward evaluation of quantile experts."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, functions as F

from fanchart.functions.metrics import METRICS, UNSCORED, mase, quantile_scores
from fanchart.grain import Grain
from fanchart.models.closed_form import residual_summary, seasonal_quantiles
from fanchart.operators.features import present_features
from fanchart.operators.folds import assign_folds, rolling_folds
from fanchart.operators.panel import drop_incomplete
from fanchart.session import cut_lineage


# Folds fitted at a time.
FOLD_JOBS = 4


def longest_lag(columns: Sequence[str]) -> int:
    """The largest n among columns named y_lag<n>, 0 if there is none."""
    lags = [int(m.group(1)) for m in (re.fullmatch(r"y_lag(\d+)", c) for c in columns) if m]
    return max(lags, default=0)


def fewest_train_rows(columns: Sequence[str]) -> int:
    """A fold with fewer training rows is skipped."""
    return max(2, longest_lag(columns) + 1)


def fold_scores(scored: DataFrame, label: str = "qty", keys: Sequence[str] = ("fold",)) -> DataFrame:
    """All metrics per fold, from predicted test rows with a ``scale`` column."""
    return scored.groupBy(*keys).agg(
        *quantile_scores(label), mase(F.col(label), F.col("p50"), F.col("scale")).alias("MASE")
    )


def mean_scores(per_fold: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean over the scored folds and their number; without any, every metric is the sentinel and n_folds is 0."""
    means = [F.coalesce(F.avg(m), F.lit(UNSCORED)).alias(m) for m in METRICS]
    return per_fold.groupBy(*keys).agg(*means, F.count("*").alias("n_folds"))


def usable_folds(assigned: DataFrame, fewest: int) -> DataFrame:
    """Folds with enough training rows and at least one test row."""
    sizes = assigned.groupBy("fold").agg(
        F.count_if(F.col("part") == "train").alias("n_train"), F.count_if(F.col("part") == "test").alias("n_test")
    )
    return sizes.filter((F.col("n_train") >= fewest) & (F.col("n_test") > 0))


def walk_forward_seasonal(features: DataFrame, grain: Grain, k: int, horizon: int) -> DataFrame:
    """Scores of the seasonal naive expert per fold, all folds in one plan over one narrow table."""
    lag_column = grain.season_column
    needed = cut_lineage(drop_incomplete(features).select("sku", "date", "qty", lag_column))
    assigned = assign_folds(needed, rolling_folds(needed, k, horizon))
    usable = usable_folds(assigned, fewest_train_rows(features.columns)).select("fold")
    # At most k fold numbers, so the broadcast is bounded.
    assigned = assigned.join(F.broadcast(usable), "fold", "left_semi")
    keys = ("fold", "sku")
    known = residual_summary(assigned.filter("part = 'train'"), lag_column, keys=keys)
    test = assigned.filter("part = 'test'").join(known, list(keys), "left")
    return fold_scores(test.withColumns(seasonal_quantiles(lag_column)))


def walk_forward(
    estimator, features: DataFrame, grain: Grain, k: int, horizon: int, parallelism: int = FOLD_JOBS
) -> DataFrame:
    """Scores of any expert per fold.

    One fit per fold, ``parallelism`` of them at a time, so that the small jobs of one fill the cores that another leaves
    idle; the folds' predictions are united and scored in a single aggregate. Pass features that are already written or
    checkpointed, as every fold reads them again.
    """
    complete = drop_incomplete(features)
    folds = rolling_folds(complete, k, horizon)
    assigned = assign_folds(complete.select("date"), folds)
    usable = usable_folds(assigned, fewest_train_rows(features.columns))
    lag_column = grain.season_column

    def predicted_fold(fold) -> DataFrame:
        train = complete.filter(F.col("date") <= F.lit(fold.train_end))
        test = complete.filter((F.col("date") > F.lit(fold.train_end)) & (F.col("date") <= F.lit(fold.test_end)))
        scored = estimator.fit(train).transform(test).withColumn("fold", F.lit(fold.fold))
        scored = scored.join(residual_summary(train, lag_column).select("sku", "scale"), "sku", "left")
        return scored.select("fold", "sku", "date", "qty", "p10", "p50", "p90", "scale")

    # At most k rows come to the driver.
    chosen = folds.join(usable, "fold").orderBy("fold").collect()
    with ThreadPool(max(1, min(parallelism, len(chosen)))) as pool:
        predicted = pool.map(inheritable_thread_target(features.sparkSession)(predicted_fold), chosen, chunksize=1)
    if not predicted:
        empty = complete.limit(0).withColumns({c: F.lit(0.0) for c in ("p10", "p50", "p90", "scale")})
        return fold_scores(empty.withColumn("fold", F.lit(0)))
    return fold_scores(reduce(DataFrame.unionByName, predicted))


def prepare_features(features: DataFrame, grain: Grain) -> DataFrame:
    """Complete feature rows, written once so that folds, trials and boosting rounds do not recompute them."""
    columns = ["date", "qty", *present_features(features, grain)]
    return cut_lineage(drop_incomplete(features.select(*columns)))
