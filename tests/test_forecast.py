from datetime import date

import pandas as pd
import pytest
import tables
from pyspark.sql import functions as F

from fanchart.grain import DAILY, MONTHLY
from fanchart.models.base import QuantileModel
from fanchart.models.closed_form import LastValue, SeasonalNaive
from fanchart.operators import forecast as fc
from fanchart.operators.features import add_features
from fanchart.operators.promo import attach_plan
from fanchart.operators.series import export_table, promo_intervals, sku_series


class Probe(QuantileModel):
    """Predicts a formula over the features, so that every step's features can be checked."""

    def __init__(self, sql, inputs):
        super().__init__()
        self.sql, self.inputs = sql, inputs

    def input_columns(self):
        return self.inputs

    def score(self, df):
        return df.withColumns({"p10": F.expr(self.sql) - 1, "p50": F.expr(self.sql), "p90": F.expr(self.sql) + 1})


def naive(panel, grain=MONTHLY):
    return SeasonalNaive(freq=grain.name).fit(add_features(panel, grain))


def p50(df, *keys):
    return {tuple(r[k] for k in keys): r.p50 for r in df.collect()}


def test_every_step_sees_the_features_a_full_recomputation_gives(spark):
    """The state loop against adding the forecasts to the panel and computing all features again, step by step."""
    values = {"a": [5, 8, 2, 9, 4, 7, 3, 6, 5, 9, 1, 4, 8, 2, 7], "b": [i % 5 * 3 + 1 for i in range(15)], "x": [4] * 9}
    panel = tables.series(spark, values).withColumns(
        {
            "comp_price_index": F.month("date") / 10.0,
            "comp_qty_index": F.lit(1.0),
            "comp_promo_flag": (F.month("date") % 3 == 0).cast("int"),
        }
    )
    # "x" ends early, so its rows have a gap before the joint start date.
    columns = ["y_lag1", "mean_3m", "y_lag12", "grp_qty_excl_lag1", "grp_mean_excl_3m", "comp_price_index_lag3",
               "comp_price_index_mean_3m", "promo_share_3m", "comp_promo_flag_lag1", "grp_trend_excl_3m"]
    formula = " + ".join(f"{0.1 * (i + 1):.1f}D * coalesce({c}, 0)" for i, c in enumerate(columns)) + " + month"
    plan = spark.createDataFrame([(date(2021, 5, 31), "ALL", 1), (date(2021, 5, 31), "b", 0)], "date date, sku string, promo_flag int")
    model = Probe(formula, columns)
    for joint in (True, False):
        ours = p50(fc.recursive_forecast(panel, model, MONTHLY, 5, plan=plan, joint=joint, quantiles="raw"), "sku", "date")
        work, wanted = panel, {}
        for _ in range(5):
            stubs = fc.future_stubs(work, MONTHLY, plan, joint)
            full = fc.with_stubs(work, stubs)
            feats = add_features(full, MONTHLY, alone=not joint)
            names = [c for c in feats.columns if c not in ("sku", "category", "date", "qty")]
            from fanchart.operators.features import forward_fill

            filled = forward_fill(feats, names)
            scored = model.score(filled.join(stubs.select("sku", "date"), ["sku", "date"]))
            got = [(r.sku, r.date, r.p50) for r in scored.collect()]
            wanted.update({(s, d): p for s, d, p in got})
            fed = spark.createDataFrame(got, "sku string, date date, p50 double")
            work = fc.feed_back(full, fed).checkpoint()
        assert ours.keys() == wanted.keys() and len(ours) == 15
        for k in ours:
            assert ours[k] == pytest.approx(wanted[k], abs=0.0051), (joint, k)


def test_beyond_one_season_repeats_the_season(spark):
    panel = tables.series(spark, {"a": range(1, 31), "short": [1, 2, 3]})
    loop = fc.recursive_forecast(panel, naive(panel), MONTHLY, 15, joint=True)
    direct = fc.seasonal_naive_direct(panel, MONTHLY, 15)
    assert loop.exceptAll(direct).count() == 0 and direct.exceptAll(loop).count() == 0
    assert loop.count() == 30


def test_start_dates(spark):
    panel = tables.series(spark, {"a": range(14), "b": range(20)})
    model = LastValue().fit(panel)
    alone = fc.recursive_forecast(panel, model, MONTHLY, 2, joint=False)
    ends = tables.month_ends(23)
    assert {(r.sku, r.date) for r in alone.collect()} == {("a", ends[14]), ("a", ends[15]), ("b", ends[20]), ("b", ends[21])}
    joint = fc.recursive_forecast(panel, model, MONTHLY, 1, joint=True)
    assert {(r.sku, r.date) for r in joint.collect()} == {("a", ends[20]), ("b", ends[20])}


def test_daily_steps(spark):
    days = [d.date() for d in pd.date_range("2024-02-20", periods=16)]
    panel = tables.panel(spark, [(d, "a", "c", float(i)) for i, d in enumerate(days)])
    forecast = fc.recursive_forecast(panel, naive(panel, DAILY), DAILY, 9, quantiles="raw")
    rows = forecast.orderBy("date").collect()
    assert [r.p50 for r in rows] == [9, 10, 11, 12, 13, 14, 15, 9, 10]
    assert rows[0].date == date(2024, 3, 7)


def test_calibration_is_clipped_and_compounds(spark):
    panel = tables.series(spark, {"a": [10.0] * 11 + [12.0, 12.0]})
    model = Probe("coalesce(y_lag1, 10D)", ["y_lag1"])
    got = fc.recursive_forecast(panel, model, MONTHLY, 3, calibrate_last_k=2, quantiles="raw")
    assert tables.column(got, "p50") == [13.2, 14.52, 15.97]  # ratio 1.1 = median(1.2, 1.0)
    once = fc.recursive_forecast(panel, model, MONTHLY, 3, calibrate_last_k=2, calibrate_once=True, quantiles="raw")
    assert tables.column(once, "p50") == [13.2, 13.2, 13.2]
    high = fc.recursive_forecast(panel, Probe("5D", []), MONTHLY, 1, calibrate_last_k=2, quantiles="raw")
    assert tables.column(high, "p50") == [7.0]
    one_row = tables.series(spark, {"a": [10]})
    assert tables.column(fc.recursive_forecast(one_row, Probe("5D", []), MONTHLY, 1, calibrate_last_k=3), "p50") == [5.0]


def test_crossing_quantiles(spark):
    crossed = spark.createDataFrame([(date(2024, 1, 31), "a", 0, 9.0, 5.0, -1.0)], "date date, sku string, promo_flag int, p10 double, p50 double, p90 double")
    assert tuple(fc.finish(crossed).first())[3:] == (0.0, 5.0, 9.0)
    assert tuple(fc.finish(crossed, "raw").first())[3:] == (9.0, 5.0, 0.0)


def test_plan_lookup(spark):
    d = date(2024, 1, 31)
    rows = [(d, "a", 0, 1), (d, "a", 1, 2), (d, "ALL", 1, 3), (date(2024, 2, 29), "b", 1, 4)]
    plan = spark.createDataFrame(rows, "date date, sku string, promo_flag int, line long")
    keys = spark.createDataFrame([(d, "a"), (d, "b"), (date(2024, 2, 29), "a"), (date(2024, 2, 29), "b")], "date date, sku string")
    got = {(r.sku, r.date.month): r.promo_flag for r in attach_plan(keys, plan).collect()}
    assert got == {("a", 1): 0, ("b", 1): 1, ("a", 2): 0, ("b", 2): 1}
    assert {r.promo_flag for r in attach_plan(keys, None).collect()} == {0}


def test_sku_in_two_categories_does_not_fan_out(spark):
    rows = [(date(2024, 1, 31), "a", "old", 1.0), (date(2024, 2, 29), "a", "new", 2.0)]
    history = tables.panel(spark, rows)
    forecast = fc.recursive_forecast(history, LastValue().fit(history), MONTHLY, 2)
    exported = export_table(forecast, history)
    assert exported.count() == 2 and {r.category for r in exported.collect()} == {"new"}
    assert sku_series(history, forecast).count() == 2 + 3 * 2


def test_promo_interval_ends(spark):
    history = tables.panel(spark, [(date(2024, 2, 29), "a", "c", 1.0, 1), (date(2024, 3, 31), "a", "c", 1.0, 0)])
    assert [tuple(r) for r in promo_intervals(history, MONTHLY).collect()] == [("a", date(2024, 2, 1), date(2024, 3, 1))]
    assert [tuple(r) for r in promo_intervals(history, DAILY).collect()] == [("a", date(2024, 2, 29), date(2024, 3, 1))]


def test_bad_arguments(spark):
    panel = tables.series(spark, {"a": [1]})
    with pytest.raises(ValueError):
        fc.recursive_forecast(panel, Probe("1D", []), MONTHLY, 0)
    with pytest.raises(ValueError):
        fc.recursive_forecast(panel, Probe("1D", []), MONTHLY, 1, quantiles="none")
