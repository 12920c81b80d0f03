import math
import random
import re

import pytest
import tables
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from fanchart.functions.quantiles import percentiles
from fanchart.grain import MONTHLY
from fanchart.models.closed_form import ConstantQuantile, LastValue, SeasonalNaive, SeasonalNaiveModel
from fanchart.models.ensemble import (
    NoValidFoldError,
    QuantileEnsemble,
    QuantileEnsembleModel,
    exponential_weights,
    mean_of_experts,
)
from fanchart.models.quantile_gbt import QuantileGBT, QuantileGBTModel, _forest, softened, target_means_by_date
from fanchart.operators.backtest import prepare_features
from fanchart.operators.features import add_features
from fanchart.operators.search import (
    best_params,
    draw,
    fit_best,
    guided_search,
    guided_trials,
    random_search,
    search_ranges,
)
from fanchart.plans.tables import sales_panel


@pytest.fixture(scope="module")
def features(spark, sf_dir):
    return prepare_features(add_features(sales_panel(spark, sf_dir, MONTHLY), MONTHLY), MONTHLY)


def first(model, df):
    return [tuple(r) for r in model.transform(df).select("p10", "p50", "p90").distinct().collect()]


def test_naive_with_few_rows_and_unknown_sku(spark):
    rows = [("1", 10.0, 8.0), ("1", 12.0, None), ("2", 5.0, 9.0)]
    train = spark.createDataFrame(rows, "sku string, qty double, y_lag12 double")
    model = SeasonalNaive(freq="monthly").fit(train)
    new = spark.createDataFrame([("1", 20.0), ("2", None), ("3", 7.0)], "sku string, y_lag12 double")
    got = {r.sku: (r.p10, r.p50, r.p90) for r in model.transform(new).collect()}
    assert got == {"1": (22.0, 20.0, 22.0), "2": (-4.0, 0.0, -4.0), "3": (7.0, 7.0, 7.0)}
    with pytest.raises(ValueError, match="y_lag7"):
        SeasonalNaive(freq="daily").fit(train)


def test_copy_keeps_every_parameter():
    tuned = QuantileGBT(rounds=7, learningRate=0.3, encoding="target").copy({})
    assert (tuned.getOrDefault("rounds"), tuned.getOrDefault("encoding")) == (7, "target")
    assert SeasonalNaive(freq="daily").copy({}).getOrDefault("freq") == "daily"
    ensemble = QuantileEnsemble(experts=[("n", SeasonalNaive(freq="daily"))], freq="daily").copy({})
    assert ensemble.experts[0][1].getOrDefault("freq") == "daily"


def test_constant_and_last_value(spark):
    train = tables.series(spark, {"a": [1, 2, 3, 4, 5], "b": [6, 7, 8, 9, None]})
    assert first(ConstantQuantile().fit(train), train) == [pytest.approx((1.8, 5.0, 8.2))]
    last = LastValue().fit(train).transform(tables.series(spark, {"a": [0], "b": [0], "x": [0]}))
    assert {r.sku: (r.p10, r.p90) for r in last.collect()} == {"a": (5.0, 5.0), "b": (9.0, 9.0), "x": (0.0, 0.0)}


def test_softened_parameters():
    assert softened(50, 6, 10_000) == (50, 6)
    assert softened(50, 6, 40) == (4, 5)
    assert softened(50, 6, 3) == (1, 1)


def test_target_code_uses_earlier_dates_only(spark):
    d = tables.month_ends(3)
    rows = [(d[0], "a", "c", 10.0), (d[0], "b", "c", 20.0), (d[1], "a", "c", 40.0), (d[2], "a", "c", 1000.0)]
    codes = target_means_by_date(tables.panel(spark, rows), "category", "qty")
    got = {r.date: r.code for r in codes.collect()}
    # nothing before the first date; then (10 + 20 + prior 15) / 3; then (70 + prior 70/3) / 4
    assert got == pytest.approx({d[0]: 0.0, d[1]: 15.0, d[2]: 70 / 3})


@pytest.mark.parametrize("encoding", ["onehot", "target"])
def test_trees_beat_the_constant_and_cover(spark, features, encoding, tmp_path):
    weighted = features.withColumn("weight", 1.0 - 0.9 * F.col("oos_flag"))
    expert = QuantileGBT(
        featureCols=MONTHLY.feature_columns(), encoding=encoding, rounds=5, learningRate=0.4, weightCol="weight",
        minInstancesPerNode=20, checkpointInterval=2,
    )
    model = expert.fit(weighted)
    scored = model.transform(features)
    assert scored.columns == [*features.columns, "p10", "p50", "p90"]

    def loss(df, q, tau):
        e = F.col("qty") - F.col(q)
        return df.agg(F.avg(F.greatest(tau * e, (tau - 1) * e))).first()[0]

    constant = ConstantQuantile().fit(features).transform(features)
    for q, tau in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9)):
        assert loss(scored, q, tau) < loss(constant, q, tau)
        covered = scored.agg(F.avg((F.col("qty") <= F.col(q)).cast("int"))).first()[0]
        assert covered == pytest.approx(tau, abs=0.06)

    model.save(str(tmp_path / encoding))
    again = QuantileGBTModel.load(str(tmp_path / encoding))
    assert again.transform(features).exceptAll(scored).count() == 0
    assert [f.getNumTrees for f in again.forests.values()] == [5] * 3 and again.input_columns() == MONTHLY.feature_columns()
    unseen = features.limit(1).withColumns({"sku": F.lit("never seen"), "y_lag12": F.lit(None).cast("double")})
    assert model.transform(unseen).first().p50 is not None


def test_forest_sums_its_own_leaf_values(spark):
    rows = spark.range(400).select(F.rand(1).alias("a"), F.rand(2).alias("b")).withColumn("y", F.col("a") * 3 + F.col("b"))
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows).cache()
    learner = DecisionTreeRegressor(labelCol="y", leafCol="leaf", predictionCol="step")
    trees = [learner.copy({learner.maxDepth: d}).fit(rows) for d in (1, 3, 4)]
    leaves = [[t * 100.0 + i * i for i in range(tree.numNodes)] for t, tree in enumerate(trees)]
    sums = _forest(spark, trees, leaves).transform(rows).select("a", "prediction")
    wanted = {}
    for tree, values in zip(trees, leaves):
        for r in tree.transform(rows).select("a", "leaf").collect():
            wanted[r.a] = wanted.get(r.a, 0.0) + values[int(r.leaf)]
    assert {r.a: r.prediction for r in sums.collect()} == wanted


def test_plan_does_not_grow_with_the_trees(features):
    sizes = []
    for rounds in (1, 6):
        expert = QuantileGBT(featureCols=["y_lag12", "month"], quantiles=["p50"], rounds=rounds, maxDepth=3)
        plan = expert.fit(features).transform(features)._jdf.queryExecution().optimizedPlan().toString()
        sizes.append(len(re.sub(r"\d+", "0", plan)))
    assert abs(sizes[1] - sizes[0]) < 0.05 * sizes[0]


def test_weights_count_in_starts_codes_and_constants(spark):
    d = tables.month_ends(2)
    rows = [(d[0], "a", "c", 10.0, 3.0), (d[0], "b", "c", 20.0, 1.0), (d[1], "a", "c", 30.0, 0.0), (d[1], "b", "c", None, 9.0)]
    train = spark.createDataFrame(rows, "date date, sku string, category string, qty double, w double")
    codes = {r.date: r.code for r in target_means_by_date(train, "category", "qty", "w").collect()}
    # (10 * 3 + 20 + the prior 12.5) / (4 + 1)
    assert codes == pytest.approx({d[0]: 0.0, d[1]: 12.5})
    assert percentiles(train, "qty", {"a": 0.5, "b": 0.75, "c": 0.8}, "w") == {"a": 10.0, "b": 10.0, "c": 20.0}
    assert percentiles(train.filter("w = 9"), "qty", {"a": 0.5}, "w") == {"a": 0.0}
    model = ConstantQuantile(weightCol="w", weighted=True).fit(train)
    assert first(model, train) == [(10.0, 10.0, 20.0)]
    assert first(ConstantQuantile(weightCol="w").fit(train), train) == [pytest.approx((12.0, 20.0, 28.0))]


def test_named_columns_choose_their_coding(features):
    inputs = ["sku", "category", "y_lag12"]
    model = QuantileGBT(featureCols=inputs, encoding="onehot", targetCols=["sku"], rounds=1).fit(features)
    assert list(model.codes) == ["sku"] and model.transform(features).count() == features.count()
    model = QuantileGBT(featureCols=inputs, encoding="target", oneHotCols=["category"], rounds=1).fit(features)
    assert list(model.codes) == ["sku"]
    assert QuantileGBT(featureCols=inputs, rounds=1).fit(features).codes == {}


def test_too_few_rows_give_constants(spark):
    train = tables.series(spark, {"a": [1, 2, 3]})
    model = QuantileGBT(featureCols=["promo_flag"]).fit(train)
    assert model.is_constant and first(model, train) == [pytest.approx((1.2, 2.0, 2.8))]


def test_ensemble_is_the_mean_and_survives_saving(spark, features, tmp_path):
    experts = [("snaive", SeasonalNaive(freq="monthly")), ("constant", ConstantQuantile()), ("last", LastValue())]
    model = QuantileEnsemble(experts=experts, halflife=18).fit(features)
    scored = model.transform(features).select("sku", "date", "p10", "p50", "p90")
    single = [m.transform(features).select("sku", "date", F.lit(n).alias("expert"), "p10", "p50", "p90") for n, m in model.fitted]
    stacked = mean_of_experts(single[0].unionByName(single[1]).unionByName(single[2]), ["sku", "date"])
    joined = scored.join(stacked.withColumnsRenamed({q: f"{q}_b" for q in ("p10", "p50", "p90")}), ["sku", "date"])
    assert joined.filter("abs(p10 - p10_b) + abs(p50 - p50_b) + abs(p90 - p90_b) > 1e-9").count() == 0
    assert joined.count() == features.count()
    model.save(str(tmp_path / "ensemble"))
    again = QuantileEnsembleModel.load(str(tmp_path / "ensemble"))
    assert again.transform(features).select(*scored.columns).exceptAll(scored).count() == 0
    report = model.report.first()
    assert report.rows == features.count() and [e["class"] for e in report.experts][0] == "SeasonalNaive"
    assert report.halflife == 18 and report.features_total == len(features.columns)


def test_exponential_ensemble(features):
    experts = [("snaive", SeasonalNaive(freq="monthly")), ("constant", ConstantQuantile())]
    model = QuantileEnsemble(experts=experts, weighting="exp", eta=5.0, folds=3).fit(features)
    assert sum(model.shares.values()) == pytest.approx(1.0) and len(set(model.shares.values())) == 2
    assert model.transform(features).filter("p50 is null").count() == 0
    one_sku = features.filter(F.col("sku") == features.agg(F.min("sku")).first()[0])
    with pytest.raises(NoValidFoldError):
        QuantileEnsemble(experts=experts, weighting="exp", horizon=500).fit(one_sku)


def test_exponential_weights_do_not_underflow(spark):
    losses = spark.createDataFrame([("a", 1000.0), ("b", 1000.2)], "expert string, loss double")
    w = {r.expert: r.weight for r in exponential_weights(losses, 5.0).collect()}
    assert w["a"] + w["b"] == pytest.approx(1.0) and w["a"] / w["b"] == pytest.approx(2.718281828)


def test_ensemble_rejects_strangers(features):
    with pytest.raises(TypeError):
        QuantileEnsemble(experts=[("x", object())]).fit(features)
    with pytest.raises(ValueError):
        QuantileEnsemble().fit(features)


def test_saved_naive(spark, features, tmp_path):
    model = SeasonalNaive(freq="monthly").fit(features)
    model.save(str(tmp_path / "naive"))
    again = SeasonalNaiveModel.load(str(tmp_path / "naive"))
    assert again.uid == model.uid
    assert again.transform(features).exceptAll(model.transform(features)).count() == 0


def test_search_ranges_and_draws():
    assert search_ranges("onehot")["rounds"] == (300, 1400) and "minInstancesPerNode" not in search_ranges("target")
    rng = random.Random(1)
    for _ in range(200):
        p = draw(search_ranges("onehot"), rng)
        assert 300 <= p["rounds"] <= 1400 and 0.02 <= p["learningRate"] <= 0.2 and 4 <= p["maxDepth"] <= 7


RANGES = {"rounds": (1, 100), "learningRate": (0.001, 1.0), "maxDepth": (1, 10)}


def bowl(_, p):
    """Least, at 0, for 30 rounds, a rate of 0.05 and a depth of 7."""
    return ((p["rounds"] - 30) / 30) ** 2 + math.log(p["learningRate"] / 0.05) ** 2 + ((p["maxDepth"] - 7) / 3) ** 2


def test_guided_draws_beat_random_ones():
    guided, plain = [], []
    for seed in range(10):
        guided.append(min(loss for _, loss, _ in guided_trials(bowl, RANGES, 40, seed)))
        rng = random.Random(seed)
        plain.append(min(bowl(0, draw(RANGES, rng)) for _ in range(40)))
    assert sum(g < p for g, p in zip(guided, plain)) >= 8 and sum(guided) < 0.5 * sum(plain)


def test_guided_draws_stay_in_their_ranges():
    for _, _, p in guided_trials(bowl, RANGES | {"minInstancesPerNode": (5, 5)}, 60, 3):
        assert 1 <= p["rounds"] <= 100 and 0.001 <= p["learningRate"] <= 1 and 1 <= p["maxDepth"] <= 10
        assert p["minInstancesPerNode"] == 5 and all(isinstance(p[n], int) for n in ("rounds", "maxDepth"))


def test_a_resumed_search_makes_the_same_trials():
    whole = guided_trials(bowl, RANGES, 25, 4, batch=3, startup=6)
    ran = []
    again = guided_trials(lambda n, p: ran.append(n) or bowl(n, p), RANGES, 25, 4, 3, 6, known=whole[:14])
    # The batch of trials 12 to 14 was not whole.
    assert again == whole and ran == list(range(12, 25))


def test_guided_search_goes_on_from_its_log(features, tmp_path):
    expert = QuantileGBT(featureCols=["y_lag12", "month"], encoding="target")
    ranges = {"rounds": (1, 2), "maxDepth": (2, 3)}
    settings = {"k": 2, "horizon": 12, "startup": 2, "log_path": str(tmp_path / "log")}
    first = guided_search(expert, features, MONTHLY, ranges, trials=2, **settings).trials.collect()
    more = guided_search(expert, features, MONTHLY, ranges, trials=3, **settings)
    rows = more.trials.orderBy("number").collect()
    assert [tuple(r) for r in rows[:2]] == [tuple(r) for r in sorted(first)] and [r.number for r in rows] == [0, 1, 2]
    assert more.best == best_params(more.trials)


def test_search_picks_the_smallest_loss(features):
    expert = QuantileGBT(featureCols=["y_lag12", "mean_12m", "month"], encoding="target")
    ranges = {"rounds": (1, 2), "maxDepth": (2, 3), "learningRate": (0.1, 0.5)}
    found = random_search(expert, features, MONTHLY, ranges, trials=2, k=2, horizon=12)
    rows = found.trials.orderBy("value").collect()
    assert len(rows) == 2 and all(r.state == "COMPLETE" and r.value < 1e5 for r in rows)
    assert found.best["rounds"] == rows[0].params_rounds == best_params(found.trials)["rounds"]
    model = fit_best(expert, features, found.best)
    assert model.forests["p50"].getNumTrees == found.best["rounds"] and set(model.forests) == {"p10", "p50", "p90"}
    with pytest.raises(NoValidFoldError):
        random_search(expert, features.limit(20), MONTHLY, ranges, trials=1, k=1, horizon=500)
