"""The registered queries: every operator over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from fanchart.functions.dates import DAY_FIRST_FORMATS, parse_date
from fanchart.functions.frames import last_known, lagged
from fanchart.functions.metrics import METRICS, mase, quantile_scores
from fanchart.functions.quantiles import exact_percentile, percentiles, weighted_quantiles
from fanchart.functions.text import normalise_sku
from fanchart.grain import DAILY, MONTHLY, Grain
from fanchart.models.closed_form import (
    ConstantQuantile,
    LastValue,
    SeasonalNaive,
    residual_summary,
    seasonal_quantiles,
)
from fanchart.models.ensemble import QuantileEnsemble, exponential_weights, training_report
from fanchart.models.quantile_gbt import QuantileGBT
from fanchart.operators import features as feat, forecast as fc, panel as pn, series as sr
from fanchart.operators.backtest import mean_scores, prepare_features, walk_forward, walk_forward_seasonal
from fanchart.operators.folds import assign_folds, rolling_folds
from fanchart.operators.promo import attach_plan
from fanchart.operators.search import guided_search
from fanchart.operators.weights import add_training_weight
from fanchart.plans.tables import daily_sales, last_year_plan, sales_panel, table, written_panel
from fanchart.schema import QUANTILES
from fanchart.session import cut_lineage, scratch_path
from fanchart.sources.sales import write_csv, write_normalised
from fanchart.sources.synthetic import synthetic_panel

Query = Callable[[SparkSession, str], DataFrame]

# Settings of the registered queries; the oracle SQL uses the same.
HORIZON = 12
FOLDS = 3
HALFLIFE = 18
ETA = 5.0
LOOKBACK = 24
LAST_K = 6
PREVIEW = 200
DIGITS = 9


def rounded(columns: list[str]) -> dict[str, Column]:
    return {c: F.round(c, DIGITS) for c in columns}


def dates_as_text(df: DataFrame) -> DataFrame:
    """ISO text for every date, so that results compare the same in any client."""
    dates = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DateType)]
    return df.withColumns({c: F.col(c).cast("string") for c in dates}) if dates else df


def complete_features(spark: SparkSession, sf_dir: str, grain: Grain = MONTHLY) -> DataFrame:
    return prepare_features(feat.add_features(written_panel(spark, sf_dir, grain), grain), grain)


def seasonal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel rows that have a seasonal lag, with the in-sample naive quantiles of their SKU."""
    panel = written_panel(spark, sf_dir, MONTHLY).select("sku", "category", "date", "qty")
    lag_column = MONTHLY.season_column
    rows = panel.withColumn(lag_column, lagged("qty", MONTHLY.season)).filter(F.col(lag_column).isNotNull())
    return rows.join(residual_summary(rows, lag_column), "sku").withColumns(seasonal_quantiles(lag_column))


# -- panel ------------------------------------------------------------------------------------------------------------


def panel_monthly(spark, sf_dir):
    return sales_panel(spark, sf_dir, MONTHLY)


def panel_daily(spark, sf_dir):
    return sales_panel(spark, sf_dir, DAILY)


def csv_round_trip(spark, sf_dir):
    """The panel written as CSV files with two headers, read as one folder, normalised, written and read again."""
    panel = sales_panel(spark, sf_dir, MONTHLY).withColumnRenamed("sku", "SKU")
    panel = cut_lineage(panel.withColumn("date", F.date_format("date", "yyyy-M-d")))
    folder = scratch_path(spark)
    odd = F.split("date", "-")[0].cast("int") % 2 == 1
    turned = [c for c in reversed(panel.columns) if c != "comp_promo_flag"]
    write_csv(panel.filter(~odd), f"{folder}/in/even")
    write_csv(panel.filter(odd).select(*turned), f"{folder}/in/odd")
    return write_normalised(spark, f"{folder}/in/*", f"{folder}/panel", MONTHLY)


def panel_extent(spark, sf_dir):
    return pn.panel_extent(sales_panel(spark, sf_dir, MONTHLY))


def sku_normalise(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    messy = (
        F.when(F.col("p_size") < 10, F.concat(key, F.lit(".0")))
        .when(F.col("p_size") < 20, F.concat(F.lit("  "), key, F.lit(" ")))
        .when(F.col("p_size") < 30, F.concat(F.col("p_brand"), F.lit(".0 ")))
        .when(F.col("p_size") < 35, F.lit("nan"))
        .when(F.col("p_size") < 40, F.lit(" None "))
        .when(F.col("p_size") < 45, F.col("p_name"))
    )
    return table(spark, sf_dir, "part").select("p_partkey", normalise_sku(messy).alias("sku"))


def parse_dates(spark, sf_dir):
    day, line = F.col("l_shipdate"), F.col("l_linenumber")
    text = (
        F.when(line == 1, F.date_format(day, "yyyy-MM-dd"))
        .when(line == 2, F.date_format(day, "d.M.yyyy"))
        .when(line == 3, F.date_format(day, "d/M/yyyy"))
        .when(line == 4, F.date_format(day, "d-M-yyyy"))
        .when(line == 5, F.date_format(day, "MMM yyyy"))
    )
    rows = table(spark, sf_dir, "lineitem").select(
        "l_linenumber", parse_date(text, DAY_FIRST_FORMATS).alias("date")
    )
    return rows.groupBy("l_linenumber", "date", F.last_day("date").alias("month")).agg(F.count("*").alias("n"))


def lookback_filter(spark, sf_dir):
    kept = pn.keep_lookback(written_panel(spark, sf_dir, MONTHLY), LOOKBACK, MONTHLY)
    return kept.select("sku", "date", "qty")


def drop_incomplete(spark, sf_dir):
    panel = feat.add_target_history(sales_panel(spark, sf_dir, MONTHLY), MONTHLY)
    kept = pn.drop_incomplete(panel, ["y_lag12", "mean_12m"])
    return kept.select("sku", "date", "qty", "y_lag12", F.round("mean_12m", DIGITS).alias("mean_12m"))


def winsorise(spark, sf_dir):
    sales = daily_sales(spark, sf_dir).withColumn("qty", F.col("l_extendedprice"))
    capped = pn.winsorise(sales)
    return capped.select("l_orderkey", "l_linenumber", "sku", F.round("qty", 6).alias("qty"))


def monthly_rollup(spark, sf_dir):
    rolled = pn.monthly_rollup(daily_sales(spark, sf_dir))
    return rolled.withColumns({"qty": F.round("qty", 6), "promo_share": F.round("promo_share", DIGITS)})


# -- features ---------------------------------------------------------------------------------------------------------


def calendar_features(spark, sf_dir):
    dates = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("date")).distinct()
    both = feat.add_calendar(feat.add_calendar(dates, MONTHLY), DAILY)
    waves = ["month_sin", "month_cos", "dow_sin", "dow_cos"]
    # + 0.0 turns a negative zero into zero.
    return both.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in waves})


def lag_features(grain: Grain) -> Query:
    def query(spark, sf_dir):
        panel = sales_panel(spark, sf_dir, grain).select("sku", "date", "qty")
        return feat.add_target_history(panel, grain).select("sku", "date", "qty", *[f"y_lag{n}" for n in grain.lags])

    return query


def rolling_features(grain: Grain) -> Query:
    def query(spark, sf_dir):
        panel = sales_panel(spark, sf_dir, grain).select("sku", "date", "qty", "promo_flag")
        rolled = feat.add_promo_history(feat.add_target_history(panel, grain), grain)
        columns = [f"mean_{n}{grain.suffix}" for n in grain.windows] + grain.promo_columns()
        return rolled.withColumns(rounded(columns)).select("sku", "date", *columns)

    return query


def group_features(grain: Grain) -> Query:
    def query(spark, sf_dir):
        panel = written_panel(spark, sf_dir, grain).select("sku", "category", "date", "qty", "promo_flag")
        grouped = feat.add_group_history(feat.add_group_totals(panel), grain)
        columns = ["grp_qty", "grp_promo_share", "grp_qty_excl", *grain.group_columns()]
        return grouped.withColumns(rounded(columns)).select("sku", "category", "date", *columns)

    return query


def competitor_features(grain: Grain) -> Query:
    def query(spark, sf_dir):
        columns = grain.competitor_columns()
        compared = feat.add_competitor_history(sales_panel(spark, sf_dir, grain), grain)
        return compared.withColumns(rounded(columns)).select("sku", "date", *columns)

    return query


def all_features_monthly(spark, sf_dir):
    """Every feature at once: the plan that training and forecasting use."""
    features = feat.add_features(written_panel(spark, sf_dir, MONTHLY), MONTHLY)
    columns = MONTHLY.history_columns()
    return features.withColumns(rounded(columns)).select("sku", "date", "month", "quarter", *columns)


def forward_fill(spark, sf_dir):
    panel = sales_panel(spark, sf_dir, MONTHLY)
    masked = panel.withColumn("qty", F.when(F.col("oos_flag") == 0, F.col("qty")))
    return masked.select("sku", "date", F.col("qty").alias("masked"), last_known("qty").alias("filled"))


def last_k_rows(spark, sf_dir):
    return fc.last_rows(sales_panel(spark, sf_dir, MONTHLY), LAST_K).select("sku", "date", "qty")


def training_weights(spark, sf_dir):
    panel = written_panel(spark, sf_dir, MONTHLY)
    weighted = add_training_weight(panel, MONTHLY, HALFLIFE)
    return weighted.select("sku", "date", F.round("weight", DIGITS).alias("weight"))


# -- evaluation -------------------------------------------------------------------------------------------------------


def metrics_wape_smape_pinball(spark, sf_dir):
    scored = seasonal_rows(spark, sf_dir).groupBy("category").agg(*quantile_scores())
    return scored.withColumns({m: F.round(m, 6) for m in METRICS if m != "MASE"})


def metrics_mase(spark, sf_dir):
    score = mase(F.col("qty"), F.col("p50"), F.col("scale"))
    scored = seasonal_rows(spark, sf_dir).withColumn("p50", F.col("p50") + F.col("r10"))
    return scored.groupBy("category").agg(F.round(score, 6).alias("MASE"))


def constant_quantiles(spark, sf_dir):
    prices = table(spark, sf_dir, "lineitem").select("l_extendedprice")
    found = exact_percentile(prices, [], "l_extendedprice", QUANTILES)
    return found.withColumns({q: F.round(q, 6) for q in QUANTILES})


def constant_quantiles_weighted(spark, sf_dir):
    """Price quantiles by quantity sold, of every return flag's own lines and of all of them."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity")
    # A handful of flags; one row per flag reaches the driver.
    flags = [r[0] for r in lines.select("l_returnflag").distinct().orderBy("l_returnflag").collect()]
    number = F.coalesce(*[F.when(F.col("l_returnflag").eqNullSafe(flag), F.lit(i)) for i, flag in enumerate(flags)], F.lit(-1))
    numbered = lines.filter("l_extendedprice is not null and l_quantity > 0").withColumn("k", number)
    found = {q: weighted_quantiles(numbered, "k", "l_extendedprice", "l_quantity", tau) for q, tau in QUANTILES.items()}
    rows = [(flag, *[float(found[q][i]) for q in QUANTILES]) for i, flag in enumerate(flags) if i in found["p50"]]
    whole = percentiles(lines, "l_extendedprice", QUANTILES, "l_quantity")
    rows.append(("ALL", *[whole[q] for q in QUANTILES]))
    return spark.createDataFrame(rows, "flag string, " + ", ".join(f"{q} double" for q in QUANTILES))


def folds(spark, sf_dir):
    return rolling_folds(written_panel(spark, sf_dir, MONTHLY), FOLDS, HORIZON)


def fold_assignment(spark, sf_dir):
    panel = written_panel(spark, sf_dir, MONTHLY)
    assigned = assign_folds(panel, rolling_folds(panel, FOLDS, HORIZON))
    return assigned.groupBy("fold", "part").agg(
        F.count("*").alias("n"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.sum("qty").alias("qty"),
    )


def naive_fold_scores(spark, sf_dir):
    return walk_forward_seasonal(
        feat.add_features(written_panel(spark, sf_dir, MONTHLY), MONTHLY), MONTHLY, FOLDS, HORIZON
    )


def walk_forward_folds(spark, sf_dir):
    return naive_fold_scores(spark, sf_dir).withColumns({m: F.round(m, 6) for m in METRICS})


def walk_forward_naive(spark, sf_dir):
    return mean_scores(naive_fold_scores(spark, sf_dir)).withColumns({m: F.round(m, 6) for m in METRICS})


# -- experts and forecasts --------------------------------------------------------------------------------------------


def seasonal_naive_forecast(spark, sf_dir):
    return fc.seasonal_naive_direct(written_panel(spark, sf_dir, MONTHLY), MONTHLY, HORIZON)


def seasonal_naive_daily(spark, sf_dir):
    return fc.seasonal_naive_direct(written_panel(spark, sf_dir, DAILY), DAILY, 14)


def naive_model(panel: DataFrame):
    """The seasonal naive expert fitted on every row that has a seasonal lag."""
    lag = feat.add_target_history(panel.select("sku", "date", "qty"), MONTHLY).select("sku", "qty", "y_lag12")
    return SeasonalNaive(freq="monthly").fit(lag)


def recursive_forecast_naive(spark, sf_dir):
    panel = written_panel(spark, sf_dir, MONTHLY)
    return fc.recursive_forecast(panel, naive_model(panel), MONTHLY, HORIZON, joint=True)


def recursive_forecast_alone(spark, sf_dir):
    panel = written_panel(spark, sf_dir, MONTHLY)
    return fc.recursive_forecast(panel, naive_model(panel), MONTHLY, HORIZON, joint=False)


def naive_calibrated(spark, sf_dir):
    panel = written_panel(spark, sf_dir, MONTHLY)
    return fc.recursive_forecast(
        panel, naive_model(panel), MONTHLY, HORIZON, joint=True, calibrate_last_k=LAST_K, quantiles="raw"
    )


def promo_plan_join(spark, sf_dir):
    panel = written_panel(spark, sf_dir, MONTHLY)
    full = fc.with_stubs(panel, fc.future_stubs(panel, MONTHLY, last_year_plan(panel)))
    return full.select("sku", "category", "date", "qty", F.col("promo_flag").cast("int").alias("promo_flag"))


def promo_plan_lookup(spark, sf_dir):
    panel = written_panel(spark, sf_dir, MONTHLY)
    return attach_plan(panel.select("sku", "date"), last_year_plan(panel), "planned_flag")


def promo_scenarios(spark, sf_dir):
    panel = written_panel(spark, sf_dir, MONTHLY)
    plan = last_year_plan(panel)
    plans = {"repeat": plan, "general": plan.filter("sku = 'ALL'")}
    return fc.recursive_forecast(panel, naive_model(panel), MONTHLY, HORIZON, plan=plans, joint=True)


def feed_back_p50(spark, sf_dir):
    panel = written_panel(spark, sf_dir, MONTHLY).select("sku", "date", "qty")
    forecast = fc.seasonal_naive_direct(panel, MONTHLY, HORIZON)
    stubs = forecast.select("sku", "date")
    return fc.feed_back(fc.with_stubs(panel, stubs), forecast)


def closed_form_experts():
    return [("snaive", SeasonalNaive(freq="monthly")), ("constant", ConstantQuantile()), ("last", LastValue())]


def ensemble_mean(spark, sf_dir):
    features = complete_features(spark, sf_dir)
    model = QuantileEnsemble(experts=closed_form_experts(), halflife=HALFLIFE).fit(features)
    return model.transform(features).select("sku", "date", *[F.round(q, 6).alias(q) for q in QUANTILES])


def ensemble_exp_weights(spark, sf_dir):
    features = complete_features(spark, sf_dir)
    losses = []
    for name, expert in closed_form_experts():
        scored = mean_scores(walk_forward(expert, features, MONTHLY, FOLDS, HORIZON))
        losses.append(scored.select(F.lit(name).alias("expert"), F.col("wMAPE").alias("loss")))
    weighted = exponential_weights(losses[0].unionByName(losses[1]).unionByName(losses[2]), ETA)
    return weighted.select("expert", F.round("loss", 6).alias("loss"), F.round("weight", 6).alias("weight"))


def ensemble_report(spark, sf_dir):
    features = complete_features(spark, sf_dir)
    ensemble = QuantileEnsemble(experts=closed_form_experts(), halflife=HALFLIFE, folds=FOLDS, horizon=HORIZON)
    report = training_report(features, ensemble.settings(), ensemble.experts)
    return report.drop("generated_at", "experts").withColumn("n_experts", F.lit(len(ensemble.experts)))


def quantile_gbt(encoding: str) -> Query:
    def query(spark, sf_dir):
        features = complete_features(spark, sf_dir)
        weighted = add_training_weight(features, MONTHLY, HALFLIFE)
        expert = QuantileGBT(
            featureCols=MONTHLY.feature_columns(), encoding=encoding, rounds=4, learningRate=0.4, weightCol="weight"
        )
        return expert.fit(weighted).transform(features).select("sku", "date", "qty", *QUANTILES)

    return query


def quantile_gbt_summary(spark, sf_dir):
    """Per coding: scored rows, and whether each quantile's pinball loss is below the training quantile's."""
    features = complete_features(spark, sf_dir)
    constant = ConstantQuantile().fit(features).transform(features)
    base = constant.agg(*quantile_scores("qty")).first()
    parts = []
    for encoding in ("onehot", "target"):
        scored = quantile_gbt(encoding)(spark, sf_dir)
        losses = scored.agg(F.count("*").alias("n_rows"), *quantile_scores("qty"))
        better = [(F.col(f"Pinball_{q}") < F.lit(base[f"Pinball_{q}"])).alias(f"{q}_better") for q in QUANTILES]
        parts.append(losses.select(F.lit(encoding).alias("encoding"), "n_rows", *better))
    return parts[0].unionByName(parts[1])


def hyperparameter_search(spark, sf_dir):
    features = complete_features(spark, sf_dir)
    ranges = {"rounds": (2, 3), "maxDepth": (3, 5), "learningRate": (0.1, 0.5), "minInstancesPerNode": (10, 200)}
    expert = QuantileGBT(featureCols=MONTHLY.feature_columns(), encoding="target")
    found = guided_search(expert, features, MONTHLY, ranges, trials=4, k=2, horizon=HORIZON, startup=2)
    return found.trials.drop("datetime_start", "datetime_complete", "duration")


# -- result tables ----------------------------------------------------------------------------------------------------


def history_and_forecast(spark, sf_dir):
    panel = written_panel(spark, sf_dir, MONTHLY)
    return panel, fc.seasonal_naive_direct(panel, MONTHLY, HORIZON)


def sku_series(spark, sf_dir):
    return sr.sku_series(*history_and_forecast(spark, sf_dir))


def category_series(spark, sf_dir):
    series = sr.category_series(*history_and_forecast(spark, sf_dir))
    return series.withColumn("value", F.round("value", 6))


def promo_intervals(spark, sf_dir):
    return sr.promo_intervals(sales_panel(spark, sf_dir, MONTHLY), MONTHLY)


def promo_intervals_daily(spark, sf_dir):
    return sr.promo_intervals(sales_panel(spark, sf_dir, DAILY), DAILY, key="category")


def any_promo(spark, sf_dir):
    flags = sr.any_promo(sales_panel(spark, sf_dir, MONTHLY))
    return flags.withColumn("any_promo", F.col("any_promo").cast("int"))


def forecast_export(spark, sf_dir):
    panel, forecast = history_and_forecast(spark, sf_dir)
    return sr.export_table(forecast, panel)


def forecast_preview(spark, sf_dir):
    panel, forecast = history_and_forecast(spark, sf_dir)
    return sr.first_rows(sr.export_table(forecast, panel), PREVIEW)


def selector_values(spark, sf_dir):
    panel = written_panel(spark, sf_dir, MONTHLY)
    skus = pn.distinct_values(panel, "sku").select(F.lit("sku").alias("selector"), F.col("sku").alias("value"))
    categories = pn.distinct_values(panel, "category").select(
        F.lit("category").alias("selector"), F.col("category").alias("value")
    )
    return skus.unionByName(categories)


def sku_category(spark, sf_dir):
    panel = written_panel(spark, sf_dir, MONTHLY)
    first = pn.first_category(panel).withColumnRenamed("category", "first_category")
    latest = pn.latest_category(panel).withColumnRenamed("category", "latest_category")
    return first.join(latest, "sku")


def synthetic(spark, sf_dir):
    """The demo generator without noise, for every part: its price sets the level, its size the trend."""
    items = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("sku"),
        F.col("p_retailprice").alias("base"),
        F.col("p_size").alias("origin"),
        (F.col("p_size") / 100.0).alias("slope"),
        F.when(F.col("p_size") > 25, F.array(F.lit(3), F.lit(9)))
        .otherwise(F.array(F.lit(11), F.lit(12)))
        .alias("promo_months"),
    )
    return synthetic_panel(items)


QUERIES: dict[str, Query] = {
    "panel_monthly": panel_monthly,
    "csv_round_trip": csv_round_trip,
    "panel_daily": panel_daily,
    "panel_extent": panel_extent,
    "sku_normalise": sku_normalise,
    "parse_dates": parse_dates,
    "lookback_filter": lookback_filter,
    "drop_incomplete": drop_incomplete,
    "winsorise": winsorise,
    "monthly_rollup": monthly_rollup,
    "calendar_features": calendar_features,
    "lag_features_monthly": lag_features(MONTHLY),
    "lag_features_daily": lag_features(DAILY),
    "rolling_features_monthly": rolling_features(MONTHLY),
    "rolling_features_daily": rolling_features(DAILY),
    "group_features_monthly": group_features(MONTHLY),
    "group_features_daily": group_features(DAILY),
    "competitor_features_monthly": competitor_features(MONTHLY),
    "competitor_features_daily": competitor_features(DAILY),
    "all_features_monthly": all_features_monthly,
    "forward_fill": forward_fill,
    "last_k_rows": last_k_rows,
    "training_weights": training_weights,
    "metrics_wape_smape_pinball": metrics_wape_smape_pinball,
    "metrics_mase": metrics_mase,
    "constant_quantiles": constant_quantiles,
    "constant_quantiles_weighted": constant_quantiles_weighted,
    "rolling_folds": folds,
    "fold_assignment": fold_assignment,
    "walk_forward_folds": walk_forward_folds,
    "walk_forward_naive": walk_forward_naive,
    "seasonal_naive_forecast": seasonal_naive_forecast,
    "seasonal_naive_daily": seasonal_naive_daily,
    "recursive_forecast_naive": recursive_forecast_naive,
    "recursive_forecast_alone": recursive_forecast_alone,
    "naive_calibrated": naive_calibrated,
    "promo_plan_join": promo_plan_join,
    "promo_plan_lookup": promo_plan_lookup,
    "promo_scenarios": promo_scenarios,
    "feed_back_p50": feed_back_p50,
    "ensemble_mean": ensemble_mean,
    "ensemble_exp_weights": ensemble_exp_weights,
    "ensemble_report": ensemble_report,
    "quantile_gbt_onehot": quantile_gbt("onehot"),
    "quantile_gbt_summary": quantile_gbt_summary,
    "quantile_gbt_target": quantile_gbt("target"),
    "hyperparameter_search": hyperparameter_search,
    "sku_series": sku_series,
    "category_series": category_series,
    "promo_intervals": promo_intervals,
    "promo_intervals_daily": promo_intervals_daily,
    "any_promo": any_promo,
    "forecast_export": forecast_export,
    "forecast_preview": forecast_preview,
    "selector_values": selector_values,
    "sku_category": sku_category,
    "synthetic_panel": synthetic,
}


def registered() -> dict[str, Query]:
    """Every query, with dates as ISO text."""

    def wrap(query: Query) -> Query:
        return lambda spark, sf_dir: dates_as_text(query(spark, sf_dir))

    return {name: wrap(query) for name, query in QUERIES.items()}
