import pytest
import tables
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fanchart.functions.metrics import UNSCORED, mase, quantile_scores
from fanchart.grain import MONTHLY
from fanchart.models.closed_form import SeasonalNaive
from fanchart.operators.backtest import (
    fewest_train_rows,
    longest_lag,
    mean_scores,
    prepare_features,
    walk_forward,
    walk_forward_seasonal,
)
from fanchart.operators.features import add_features
from fanchart.operators.folds import assign_folds, rolling_folds


def folds(spark, n, k, horizon):
    panel = tables.series(spark, {"a": range(n), "b": range(n)})
    index = {d: i for i, d in enumerate(tables.month_ends(n))}
    rows = rolling_folds(panel, k, horizon).orderBy("fold").collect()
    return [tuple(index[d] for d in (r.train_start, r.train_end, r.test_start, r.test_end)) for r in rows]


def test_folds(spark):
    assert folds(spark, 20, 3, 4) == [(0, 0, 1, 4), (0, 7, 8, 11), (0, 15, 16, 19)]
    assert folds(spark, 8, 4, 5) == [(0, 0, 1, 5), (0, 1, 2, 6), (0, 2, 3, 7)]  # more folds asked than anchors
    assert folds(spark, 10, 1, 3) == [(0, 0, 1, 3)]
    assert folds(spark, 5, 3, 12) == [(0, 0, 1, 4)]  # horizon longer than the dates


def test_too_few_dates(spark):
    with pytest.raises(PySparkException, match="need 3 dates"):
        rolling_folds(tables.series(spark, {"a": [1, 2]}), 3, 1).collect()


def test_assignment_is_a_broadcast_range_join(spark):
    panel = tables.series(spark, {"a": range(20)})
    assigned = assign_folds(panel, rolling_folds(panel, 3, 4))
    counts = {(r.fold, r.part): r["count"] for r in assigned.groupBy("fold", "part").count().collect()}
    assert counts == {(0, "train"): 1, (0, "test"): 4, (1, "train"): 8, (1, "test"): 4, (2, "train"): 16, (2, "test"): 4}
    assert "CartesianProduct" not in assigned._jdf.queryExecution().executedPlan().toString()


def test_metrics_by_hand(spark):
    rows = spark.createDataFrame(
        [(10.0, 8.0, 12.0, 20.0, 4.0), (0.0, 0.0, 0.0, 0.0, None)], "qty double, p10 double, p50 double, p90 double, scale double"
    )
    r = rows.agg(*quantile_scores(), mase(F.col("qty"), F.col("p50"), F.col("scale")).alias("MASE")).first()
    assert r.wMAPE == 0.2 and r.sMAPE == pytest.approx((2 * 2 / 22) / 2)
    assert r.Pinball_p10 == pytest.approx(0.1) and r.Pinball_p50 == 0.5 and r.Pinball_p90 == pytest.approx(0.5)
    assert r.MASE == 0.5
    zero = rows.filter("qty = 0").withColumn("p50", F.lit(1.0)).agg(*quantile_scores()).first()
    assert zero.wMAPE == pytest.approx(1e9) and zero.sMAPE == 2.0


def test_lag_gate():
    assert longest_lag(["y_lag3", "y_lag12", "my_lag99", "y_lag"]) == 12
    assert fewest_train_rows(["qty"]) == 2 and fewest_train_rows(["y_lag7"]) == 8


def test_no_usable_fold_gives_the_sentinel(spark):
    panel = tables.series(spark, {"a": range(18)})
    features = add_features(panel, MONTHLY)
    row = mean_scores(walk_forward_seasonal(features, MONTHLY, 3, 12)).first()
    assert row.n_folds == 0 and row.wMAPE == row.MASE == UNSCORED
    row = mean_scores(walk_forward(SeasonalNaive(freq="monthly"), prepare_features(features, MONTHLY), MONTHLY, 3, 12))
    assert row.first().n_folds == 0


def test_both_walk_forwards_agree(spark):
    values = {s: [(i * k) % 17 + i for i in range(48)] for s, k in (("a", 3), ("b", 5), ("c", 7))}
    features = add_features(tables.series(spark, values), MONTHLY)
    one_plan = {r.fold: r.asDict() for r in walk_forward_seasonal(features, MONTHLY, 3, 6).collect()}
    prepared = prepare_features(features, MONTHLY)
    loop = {r.fold: r.asDict() for r in walk_forward(SeasonalNaive(freq="monthly"), prepared, MONTHLY, 3, 6).collect()}
    assert one_plan.keys() == loop.keys() and len(loop) == 2  # the first fold has one training date and is skipped
    for fold in loop:
        assert loop[fold] == pytest.approx(one_plan[fold])
