from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from fanchart.functions.dates import MONTH_FIRST_FORMATS
from fanchart.grain import DAILY, MONTHLY
from fanchart.models.closed_form import SeasonalNaive
from fanchart.plans import run as plan
from fanchart.plans.manifest import input_version, is_finished, run_stage
from fanchart.plans.run import RunConfig, forecast_saved, load_panel, run
from fanchart.schema import PANEL_TYPES, MissingColumnError
from fanchart.session import small_side
from fanchart.sources import params, sales, synthetic
from fanchart.sources.synthetic import demo_items, synthetic_panel

MESSY = '﻿"date","sku","category","qty","promo_flag"\n2024-01-05,"Jack ""big"", 2t","tools",548.000,1\nbad,102025.0,,x,0\n'


def test_csv_with_bom_quotes_and_bad_values(spark, tmp_path):
    path = tmp_path / "sales.csv"
    path.write_text(MESSY, encoding="utf-8")
    good, bad = sorted(sales.read_sales(spark, str(path), MONTHLY).collect(), key=lambda r: r.date is None)
    assert (good.date, good.sku, good.category, good.qty) == (date(2024, 1, 31), 'Jack "big", 2t', "tools", 548.0)
    assert (bad.date, bad.sku, bad.category, bad.qty) == (None, "102025", "ALL", None)


def test_headers_of_many_files_are_one_job(spark, tmp_path):
    folder = tmp_path / "many + files é"
    folder.mkdir()
    for i in range(40):
        head, row = [("date,sku,qty", f"2024-01-05,{i},{i}"), ("qty,sku,date", f"{i},{i},2024-01-05")][i % 2]
        (folder / f"part {i:02}.csv").write_text("\n" * (i % 3) + f"{head}\n" + f"{row}\n" * (2000 if i < 2 else 1), encoding="utf-8")
    (folder / "empty.csv").write_text("", encoding="utf-8")
    spark.sparkContext.setJobGroup("headers", "headers")
    try:
        raw = sales.read_raw_sales(spark, str(folder))
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("headers")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # One for the header lines, its aggregate planned anew counting as a second, and one per distinct header.
    assert len(jobs) <= 4
    got = {(r.sku, r.qty, r.date): r["count"] for r in raw.groupBy("sku", "qty", "date").count().collect()}
    assert got == {(str(i), float(i), "2024-01-05"): 2000 if i < 2 else 1 for i in range(40)}
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") != sales.HEADER_SCAN["spark.sql.files.maxPartitionBytes"]


def test_files_without_rows(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text("", encoding="utf-8")
    assert sales.read_raw_sales(spark, str(tmp_path)).columns == []


def test_numeric_sku_stays_text(spark, tmp_path):
    path = tmp_path / "sales.csv"
    path.write_text("date,sku,qty\r\n8.21.2025,102025,-3\r\n", encoding="utf-8")
    row = sales.read_sales(spark, str(path), DAILY, MONTH_FIRST_FORMATS).first()
    assert (row.date, row.sku, row.qty) == (date(2025, 8, 21), "102025", -3.0)
    assert sales.read_raw_sales(spark, str(path)).first().date == "8.21.2025"


def test_promo_plan(spark, tmp_path):
    path = tmp_path / "plan.csv"
    path.write_text("date,sku,promo_flag\n2024-01-05,7,1\n2024-01-09,7,0\n", encoding="utf-8")
    rows = sales.read_promo_plan(spark, str(path), MONTHLY).orderBy("line").collect()
    assert [(r.date, r.sku, r.category, r.promo_flag) for r in rows] == [(date(2024, 1, 31), "7", "ALL", f) for f in (1, 0)]
    path.write_text("date,sku\n2024-01-05,7\n", encoding="utf-8")
    with pytest.raises(MissingColumnError, match="promo_flag"):
        sales.read_promo_plan(spark, str(path), MONTHLY)


def test_panel_is_written_by_year(spark, tmp_path):
    source, target = tmp_path / "sales.csv", str(tmp_path / "panel")
    source.write_text("date,qty\n2023-01-05,1\n2024-01-05,2\n", encoding="utf-8")
    panel = sales.write_normalised(spark, str(source), target, MONTHLY)
    assert panel.count() == 2 and (tmp_path / "panel" / "year=2024").exists() and "year" not in panel.columns
    with pytest.raises(ValueError):
        sales.write_normalised(spark, target, target, MONTHLY)


def test_forecast_round_trip(spark, tmp_path):
    schema = "date date, sku string, promo_flag int, p10 double, p50 double, p90 double"
    forecast = spark.createDataFrame([(date(2024, 1, 31), 'a "b", c', 1, 0.5, 1.25, 2.0)], schema)
    sales.write_forecast(forecast, str(tmp_path / "f"))
    assert sales.read_forecast(spark, str(tmp_path / "f")).collect() == forecast.collect()
    with pytest.raises(FileNotFoundError):
        sales.read_forecast(spark, str(tmp_path / "missing"))


def test_best_params(spark, tmp_path):
    path = str(tmp_path / "best")
    assert params.load_best_params(spark, path) is None
    params.write_best_params(spark, {"rounds": 3, "learningRate": 0.1}, path)
    assert params.load_best_params(spark, path) == {"rounds": 3, "learningRate": 0.1}
    (tmp_path / "bad.json").write_text("not json")
    assert params.load_best_params(spark, str(tmp_path / "bad.json")) is None


def test_demo_panel(spark):
    rows = synthetic_panel(demo_items(spark)).collect()
    assert sorted(rows) == sorted(synthetic_panel(demo_items(spark).repartition(7)).collect())
    plain = {(r.sku, r.date): r.qty for r in synthetic_panel(demo_items(spark), noise=0.0).collect()}
    off = [r.qty - plain[r.sku, r.date] for r in rows if r.qty and plain[r.sku, r.date]]
    assert abs(sum(off) / len(off)) < 1.2 and 4 < (sum(x * x for x in off) / len(off)) ** 0.5 < 6
    assert len(rows) == 3 * 72 and min(r.qty for r in rows) >= 0
    assert {(r.sku, r.date.month) for r in rows if r.promo_flag} == {("A", 3), ("A", 9), ("B", 11), ("B", 12)}


def test_panel_of_one_large_file_is_made_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(synthetic, "ITEMS_A_TASK", 20, raising=False)
    items = [(f"s{i % 190}" if i else None, float(i), i % 50, i / 100, [3, 9] if i % 2 else []) for i in range(200)]
    items = spark.createDataFrame(items, synthetic.ITEM_SCHEMA).coalesce(1)
    panel = synthetic_panel(items)
    tasks = panel.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == 10 and sum(r[1] for r in tasks) == 200 * 72 and max(r[1] for r in tasks) <= 2 * 20 * 72
    one = synthetic_panel(items.filter("sku is null")).collect()
    assert len(one) == 72 and {r.promo_flag for r in one} == {0}
    assert synthetic_panel(items.limit(0)).count() == 0


def test_small_side_is_broadcast_only_below_the_limit(spark):
    large, side = spark.range(1000).withColumnRenamed("id", "k"), spark.range(50).withColumnRenamed("id", "k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = large.join(small_side(side, 50), "k")._jdf.queryExecution().executedPlan().toString()
        many = large.join(small_side(side, 49), "k")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in few and "SortMergeJoin" in many


def test_whole_run(spark, tmp_path):
    demo = synthetic_panel(demo_items(spark)).coalesce(1)
    demo.write.option("header", True).csv(str(tmp_path / "in"))
    (tmp_path / "plan.csv").write_text("date,sku,promo_flag\n2025-01-15,ALL,1\n", encoding="utf-8")
    config = RunConfig(
        input_path=str(tmp_path / "in"), output_path=str(tmp_path / "out"), horizon=3, rounds=2, trials=2,
        search=("target",), search_round_scale=600, search_folds=2, lookback_months=60, calibrate_last_k=3, promo_path=str(tmp_path / "plan.csv"),
    )
    forecast = run(spark, config).collect()
    assert len(forecast) == 9 and all(0 <= r.p10 <= r.p50 <= r.p90 for r in forecast)
    assert {r.date.month for r in forecast if r.promo_flag} == {1}
    written = sales.read_forecast(spark, str(tmp_path / "out" / "forecast_monthly"))
    assert sorted(written.collect()) == sorted(forecast)
    names = {p.name for p in (tmp_path / "out").iterdir()}
    assert names == {
        "panel_monthly", "search_trials_target_monthly", "best_params_target_monthly", "model_target_monthly_best",
        "model_ensemble_monthly", "ensemble_report_monthly", "forecast_monthly", "forecast_export_monthly",
    }
    again = forecast_saved(spark, config)
    assert sorted(again.collect()) == sorted(forecast)
    report = spark.read.json(str(tmp_path / "out" / "ensemble_report_monthly")).first()
    assert [e["name"] for e in report.experts] == ["onehot", "target", "snaive"] and report.rows == 3 * 49
    assert set(report.experts[0].cat_cols) <= set(report.experts[0].feature_names) and report.experts[2].cat_cols is None


def test_stages_are_recorded_when_finished(spark, tmp_path):
    folder, done = str(tmp_path), []
    assert run_stage(spark, folder, "a", "1", lambda: done.append("a1")) and is_finished(spark, folder, "a", "1")
    assert not run_stage(spark, folder, "a", "1", lambda: done.append("again")) and not is_finished(spark, folder, "a", "2")
    with pytest.raises(ZeroDivisionError):
        run_stage(spark, folder, "a", "2", lambda: 1 / 0)
    assert not is_finished(spark, folder, "a", "1") and not is_finished(spark, folder, "a", "2")
    assert run_stage(spark, folder, "a", "1", lambda: done.append("a1"))
    # What nobody records replaces the outputs all the same.
    assert run_stage(spark, folder, "a", None, lambda: done.append("free")) and not is_finished(spark, folder, "a", "1")
    assert done == ["a1", "a1", "free"]


def test_a_run_goes_on_behind_its_finished_stages(spark, tmp_path, monkeypatch):
    synthetic_panel(demo_items(spark)).coalesce(1).write.option("header", True).csv(str(tmp_path / "in"))
    config = RunConfig(
        input_path=str(tmp_path / "in"), output_path=str(tmp_path / "out"), horizon=2, lookback_months=48, resume=True, joint=False
    )
    monkeypatch.setattr(plan, "QuantileGBT", lambda **_: SeasonalNaive(freq="monthly"))
    done = []

    def noted(name):
        work = getattr(plan, name)
        monkeypatch.setattr(plan, name, lambda *args: (done.append(name), work(*args))[1])

    noted("write_normalised")
    noted("_train")

    def dies(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as lost:
        lost.setattr(plan, "forecast", dies)
        with pytest.raises(RuntimeError):
            run(spark, config)
    assert done == ["write_normalised", "_train"]
    assert run(spark, config).count() == 6 and done == ["write_normalised", "_train"]
    # Only the forecast: settings that concern it alone leave both stages as they are.
    plan.train(spark, replace(config, clip_low=0.1), load_panel(spark, config))
    assert done == ["write_normalised", "_train"]
    plan.train(spark, replace(config, halflife=6), load_panel(spark, config))
    assert done == ["write_normalised", "_train", "_train"]
    before = input_version(spark, config.input_path)
    (tmp_path / "in" / "new.csv").write_text("date,sku,category,qty,promo_flag\n2030-01-31,A,X,5,0\n", encoding="utf-8")
    assert input_version(spark, config.input_path) != before
    load_panel(spark, config)
    assert done[3:] == ["write_normalised"]


def test_columns_in_different_orders_and_missing_ones(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("date,sku,qty,promo_flag\n2024-01-31,A,5,1\n", encoding="utf-8")
    (tmp_path / "in" / "b.csv").write_text("sku,date,promo_flag,qty\nB,2024-02-29,0,7\n", encoding="utf-8")
    (tmp_path / "in" / "c.csv").write_text("qty,sku,date\n9,C,2024-03-31\n", encoding="utf-8")
    rows = sales.read_sales(spark, str(tmp_path / "in"), MONTHLY).orderBy("sku").collect()
    assert [(r.sku, str(r.date), r.qty) for r in rows] == [("A", "2024-01-31", 5), ("B", "2024-02-29", 7), ("C", "2024-03-31", 9)]
    assert [r.promo_flag for r in rows][:2] == [1, 0]


def test_bad_values_are_counted(spark, tmp_path):
    path = str(tmp_path / "bad.csv")
    (tmp_path / "bad.csv").write_text("date,sku,qty\n1.6.2024,A,5\n8.22.2025,A,x\n,A,\n2024-01-01,A,3\n", encoding="utf-8")
    assert sales.count_bad_values(spark, path, PANEL_TYPES) == {"date": 2, "qty": 1}
    assert sales.count_bad_values(spark, path, PANEL_TYPES, MONTH_FIRST_FORMATS) == {"qty": 1}
    with pytest.raises(sales.BadValuesError, match="'date': 2"):
        sales.write_normalised(spark, path, str(tmp_path / "out"), MONTHLY)


def test_daily_file_rolled_up(spark, tmp_path):
    (tmp_path / "daily.csv").write_text("date,sku,qty\n1.6.2024,A,5\n1.8.2024,A,7\n2.1.2024,A,1\n", encoding="utf-8")
    config = RunConfig(
        input_path=str(tmp_path / "daily.csv"), output_path=str(tmp_path / "out"), roll_up=True, date_formats=MONTH_FIRST_FORMATS
    )
    rows = load_panel(spark, config).orderBy("date").collect()
    assert [str(r.date) for r in rows] == ["2024-01-31", "2024-02-29"] and rows[0].qty == pytest.approx(11.96)
