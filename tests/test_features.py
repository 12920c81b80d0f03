from datetime import date

import pytest
import tables
from pyspark.sql import functions as F

from fanchart.grain import DAILY, MONTHLY
from fanchart.operators import features as feat
from fanchart.operators.panel import ensure_columns
from fanchart.operators.weights import add_training_weight


def at(df, sku, day):
    return df.filter((F.col("sku") == sku) & (F.col("date") == F.lit(day))).first()


def test_short_series_and_null_in_frame(spark):
    panel = tables.series(spark, {"a": [1, 2, None, 4, 5, 6, 7], "b": [10, 20]})
    df = feat.add_features(panel, MONTHLY)
    ends = tables.month_ends(7)
    assert [r.mean_3m for r in df.filter("sku = 'a'").orderBy("date").collect()] == [None] * 6 + [5.0]
    assert at(df, "a", ends[3]).y_lag1 is None and at(df, "a", ends[4]).y_lag3 == 2.0
    assert at(df, "b", ends[1]).y_lag1 == 10.0 and at(df, "b", ends[1]).y_lag3 is None


def test_gap_is_not_filled(spark):
    rows = [(date(2024, 1, 31), "a", "c", 1.0), (date(2024, 4, 30), "a", "c", 2.0)]
    assert at(feat.add_features(tables.panel(spark, rows), MONTHLY), "a", date(2024, 4, 30)).y_lag1 == 1.0


def test_leave_one_out_reads_the_same_date(spark):
    panel = tables.series(spark, {"a": [1, 2, 3, 4], "b": [10, 20, 30, 40]})
    last = at(feat.add_features(panel, MONTHLY), "a", tables.month_ends(4)[3])
    assert (last.grp_qty_excl, last.grp_qty_excl_lag1, last.grp_mean_excl_3m) == (40.0, 30.0, 20.0)
    assert last.grp_trend_excl_3m == 20.0
    alone = at(feat.add_features(panel, MONTHLY, alone=True), "a", tables.month_ends(4)[3])
    assert (alone.grp_qty_excl_lag1, alone.grp_mean_excl_3m, alone.grp_trend_excl_3m) == (0.0, 0.0, 0.0)


def test_all_null_category_date(spark):
    totals = feat.group_totals(tables.panel(spark, [(date(2024, 1, 31), "a", "c", None)])).first()
    assert totals.grp_qty == 0.0


@pytest.mark.parametrize("grain", [MONTHLY, DAILY])
def test_no_feature_sees_its_own_date_or_later(spark, grain):
    from datetime import timedelta

    days = tables.month_ends(40) if grain is MONTHLY else [date(2024, 1, 1) + timedelta(days=i) for i in range(40)]
    rows = [(d, s, "c", float(i * k)) for i, d in enumerate(days) for k, s in ((1, "a"), (3, "b"), (7, "x"))]
    panel = ensure_columns(tables.panel(spark, rows))
    cut = days[30]
    later = F.col("date") >= F.lit(cut)
    changed = panel.withColumns(
        {
            "qty": F.when(later, F.col("qty") * 10 + 1).otherwise(F.col("qty")),
            "comp_price_index": F.when(later, 5.0).otherwise(F.col("comp_price_index")),
        }
    )
    columns = grain.history_columns()
    before = feat.add_features(panel, grain).filter(F.col("date") <= F.lit(cut)).select("sku", "date", *columns)
    after = feat.add_features(changed, grain).filter(F.col("date") <= F.lit(cut)).select("sku", "date", *columns)
    assert before.exceptAll(after).count() == 0
    assert before.filter(F.col("date") == F.lit(cut)).na.drop().count() == 3


def test_forward_fill_keeps_leading_nulls(spark):
    filled = feat.forward_fill(tables.series(spark, {"a": [None, 1, None, 3, None]}), ["qty"])
    assert tables.column(filled, "qty") == [None, 1.0, 1.0, 3.0, 3.0]


def test_weights_follow_dates(spark):
    rows = [(date(2024, 1, 31), "z", "c", 1.0, 0, 0), (date(2024, 3, 31), "a", "c", 1.0, 0, 1)]
    weights = {r.sku: r.weight for r in add_training_weight(tables.panel(spark, rows), MONTHLY, 2).collect()}
    assert weights == pytest.approx({"z": 0.5, "a": 0.1})
    plain = {r.sku: r.weight for r in add_training_weight(tables.panel(spark, rows), MONTHLY, None).collect()}
    assert plain == pytest.approx({"z": 1.0, "a": 0.1})


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("grain", [MONTHLY, DAILY])
def test_feature_plan_has_one_window_shuffle_and_no_single_task(spark, sf_dir, grain):
    from fanchart.plans.tables import written_panel

    plan = plan_of(feat.add_features(written_panel(spark, sf_dir, grain), grain))
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert plan.count("Exchange hashpartitioning(sku") == 1
    assert "BroadcastHashJoin" in plan


def test_scan_reads_only_the_needed_columns(spark, sf_dir):
    from fanchart.plans.tables import sales_panel

    plan = plan_of(sales_panel(spark, sf_dir, MONTHLY).select("sku", "date", "qty"))
    for unused in ("l_orderkey", "l_suppkey", "l_tax", "p_name", "p_size"):
        assert unused not in plan
