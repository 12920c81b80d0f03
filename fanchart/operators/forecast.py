"""Recursive multi-step forecasts for all SKUs at once.

The loop state is one row per SKU: the newest rows of its history as an array no longer than the longest lag, and the
last known value of each history feature. The features of the next period are expressions on that row, so a step
needs no window and no shuffle by SKU. Only the joint mode exchanges anything between SKUs, one quantity per category, and only for a
model that reads the category features.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from fanchart.functions.dates import calendar_columns, step_date
from fanchart.functions.frames import lagged
from fanchart.functions.rounding import clip_and_round, sorted_quantiles
from fanchart.grain import COMPETITOR_COLUMNS, Grain
from fanchart.models.base import QuantileModel
from fanchart.models.closed_form import seasonal_quantiles
from fanchart.operators.features import add_features
from fanchart.operators.panel import ensure_columns
from fanchart.operators.promo import attach_plan
from fanchart.schema import QUANTILES
from fanchart.session import BROADCAST_ROWS, cut_lineage

# Smallest forecast a calibration ratio divides by, and fewest rows it needs.
SMALLEST_FORECAST = 1e-6
FEWEST_CALIBRATION_ROWS = 2



def recent_columns(needed: list[str], grain: Grain) -> list[str]:
    """The panel columns whose newest rows the ``needed`` history features are made from."""
    sources = {"qty": grain.target_columns(), "promo_flag": grain.promo_columns(), "grp_qty_excl": grain.group_columns()}
    for c in COMPETITOR_COLUMNS:
        windows = [grain.competitor_window_name(c, n) for n in grain.competitor_windows]
        sources[c] = [f"{c}_lag{n}" for n in grain.lags] + windows
    return ["qty", *[s for s, made in sources.items() if s != "qty" and set(made) & set(needed)]]


def last_rows(df: DataFrame, k: int) -> DataFrame:
    """The newest ``k`` rows of each SKU."""
    newest = Window.partitionBy("sku").orderBy(F.col("date").desc())
    return df.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= k).drop("age")


def calibration_ratios(scored: DataFrame, low: float = 0.6, high: float = 1.4) -> DataFrame:
    """Median of actual over p50 per SKU, clipped, as (sku, ratio). ``scored`` holds the last k rows of each SKU."""
    ratio = F.col("qty") / F.greatest(F.col("p50"), F.lit(SMALLEST_FORECAST))
    clipped = F.least(F.greatest(F.median(ratio), F.lit(low)), F.lit(high))
    enough = F.count("*") >= FEWEST_CALIBRATION_ROWS
    return scored.groupBy("sku").agg(F.when(enough, clipped).alias("ratio"))


def loop_state(features: DataFrame, grain: Grain, joint: bool, needed: list[str]) -> DataFrame:
    """One row per SKU: category, last date, recent rows (newest first) and last known features.

    Only what the ``needed`` history features take is kept; Spark prunes the rest from ``features``.
    """
    recent_names = recent_columns(needed, grain)
    newest = Window.partitionBy("sku").orderBy(F.col("date").desc())
    recent = F.struct("age", *[F.col(c).cast("double").alias(c) for c in recent_names])
    carried = ["oos_flag", *COMPETITOR_COLUMNS, *needed]
    known = [
        F.max_by(F.col(c).cast("double"), F.when(F.col(c).isNotNull(), F.col("date"))).alias(c) for c in carried
    ]
    rows = features.withColumn("age", F.row_number().over(newest))
    state = rows.groupBy("sku").agg(
        F.min_by("category", "date").alias("category"),
        F.max("date").alias("last_date"),
        F.array_sort(F.collect_list(F.when(F.col("age") <= grain.max_lag, recent))).alias("recent"),
        *known,
    )
    state = state.select(
        "sku",
        "category",
        "last_date",
        F.transform("recent", lambda r: F.struct(*[r[c].alias(c) for c in recent_names])).alias("recent"),
        F.struct(*carried).alias("known"),
    )
    if joint:
        state = state.withColumn("last_date", features.agg(F.max("date").alias("d")).scalar())
    return state


def future_promotions(
    state: DataFrame, plan: DataFrame | dict[str, DataFrame] | None, grain: Grain, horizon: int
) -> DataFrame:
    """Attach ``planned``: the promotion flags of the next ``horizon`` periods, one array per SKU.

    All periods are looked up in one join, before the loop. With several named plans a SKU gets one row per
    ``scenario``.
    """
    if plan is None:
        return state.withColumn("planned", F.array_repeat(F.lit(0), horizon))
    step = F.col("step")
    future = state.select("sku", "last_date", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    future = future.select("sku", "step", step_date(F.col("last_date"), step, grain).alias("date"))

    def flags(one: DataFrame) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("step", "promo_flag")))
        return attach_plan(future, one).groupBy("sku").agg(ordered["promo_flag"].alias("planned"))

    if isinstance(plan, dict):
        named = [flags(one).withColumn("scenario", F.lit(name)) for name, one in plan.items()]
        return state.join(reduce(DataFrame.unionByName, named), "sku")
    return state.join(flags(plan), "sku")


def _lag(column: str, n: int) -> str:
    return f"get(recent, {n - 1}).{column}"


def _mean(column: str, n: int) -> str:
    """Oldest first; one missing value makes the mean NULL."""
    return "(" + " + ".join(_lag(column, i) for i in range(n, 0, -1)) + f") / {n}D"


def next_features(grain: Grain, needed: list[str]) -> dict[str, Column]:
    """The ``needed`` history features of the period after the state's recent rows, as expressions on the state."""
    own = {f"y_lag{n}": _lag("qty", n) for n in grain.lags}
    own |= {f"mean_{n}{grain.suffix}": _mean("qty", n) for n in grain.windows}
    own |= {f"promo_share_{n}{grain.suffix}": _mean("promo_flag", n) for n in grain.promo_windows}
    own |= {f"grp_qty_excl_lag{n}": _lag("grp_qty_excl", n) for n in grain.lags}
    own |= {f"grp_mean_excl_{n}{grain.suffix}": _mean("grp_qty_excl", n) for n in grain.windows}
    own[grain.trend_column] = f"{_lag('grp_qty_excl', 1)} - {_lag('grp_qty_excl', grain.trend_lag)}"
    for c in COMPETITOR_COLUMNS:
        own |= {f"{c}_lag{n}": _lag(c, n) for n in grain.lags}
        own |= {grain.competitor_window_name(c, n): _mean(c, n) for n in grain.competitor_windows}
    return {name: F.expr(f"coalesce({own[name]}, known.{name})") for name in needed}


def step_columns(grain: Grain, needed: list[str]) -> dict[str, Column]:
    """All model inputs of the next period. ``out`` tells how many periods are done, so every step uses the same ones."""
    date = step_date(F.col("last_date"), F.size("out") + 1, grain)
    return {
        "date": date,
        **calendar_columns(date, grain),
        **next_features(grain, needed),
        **{c: F.col(f"known.{c}") for c in ("oos_flag", *COMPETITOR_COLUMNS)},
        "promo_flag": F.get("planned", F.size("out")),
    }


def scored_columns(needed: list[str], once: bool) -> dict[str, Column]:
    """State columns a scored period changes, and ``fed`` and ``flag``, which become the newest recent row."""
    ratio = F.coalesce("ratio", F.lit(1.0))
    point = F.struct(
        F.col("date"),
        F.col("promo_flag").cast("int").alias("promo_flag"),
        *[(F.col(q) * ratio).alias(q) for q in QUANTILES],
    )
    return {
        "known": F.struct("oos_flag", *COMPETITOR_COLUMNS, *needed),
        "out": F.concat("out", F.array(point)),
        "fed": F.col("p50") if once else F.col("p50") * ratio,
        "flag": F.col("promo_flag").cast("double"),
    }


def _remember(state: DataFrame, grain: Grain, needed: list[str], rest: Column) -> DataFrame:
    """Put the scored period in front of the recent rows; its competitor values are not known."""
    values = {"qty": F.col("fed"), "promo_flag": F.col("flag"), "grp_qty_excl": rest}
    unknown = F.lit(None).cast("double")
    newest = F.struct(*[values.get(c, unknown).alias(c) for c in recent_columns(needed, grain)])
    longer = F.slice(F.concat(F.array(newest), "recent"), 1, grain.max_lag)
    return state.withColumn("recent", longer).drop("fed", "flag")


def recursive_forecast(
    panel: DataFrame,
    model: QuantileModel,
    grain: Grain,
    horizon: int,
    plan: DataFrame | dict[str, DataFrame] | None = None,
    joint: bool = False,
    calibrate_last_k: int = 0,
    clip_low: float = 0.6,
    clip_high: float = 1.4,
    calibrate_once: bool = False,
    quantiles: str = "sorted",
) -> DataFrame:
    """p10, p50, p90 of the next ``horizon`` periods of every SKU, each step fed with the p50 before it.

    ``joint`` starts every SKU after the panel's last date and lets category features see the other SKUs' forecasts;
    otherwise each SKU starts after its own last date and is looked at alone. ``calibrate_last_k`` scales a SKU by the
    median ratio of its last actuals to their p50; the scaled value is fed back unless ``calibrate_once``.
    ``quantiles`` is ``sorted`` or ``raw`` (quantiles may cross). ``plan`` may map scenario names to plans.
    """
    if horizon < 1:
        raise ValueError("horizon must be at least 1")
    if quantiles not in ("sorted", "raw"):
        raise ValueError("quantiles must be sorted or raw")
    needed = [c for c in grain.history_columns() if c in set(model.input_columns())]
    shared = joint and bool(set(needed) & set(grain.group_columns()))
    features = add_features(ensure_columns(panel).filter(F.col("date").isNotNull()), grain, alone=not shared)
    state = future_promotions(loop_state(features, grain, joint, needed), plan, grain, horizon)
    if calibrate_last_k > 0:
        tail = model.transform(last_rows(features, calibrate_last_k))
        state = state.join(calibration_ratios(tail, clip_low, clip_high), "sku", "left")
    else:
        state = state.withColumn("ratio", F.lit(1.0))
    nothing = "array<struct<date:date,promo_flag:int,p10:double,p50:double,p90:double>>"
    state = cut_lineage(model.attach(state.withColumn("out", F.array().cast(nothing))))

    group = [c for c in ("scenario", "category") if c in state.columns]
    few = shared and state.select(*group).distinct().count() <= BROADCAST_ROWS
    inputs, outputs = step_columns(grain, needed), scored_columns(needed, calibrate_once)
    kept = [F.col(c) for c in state.columns if c not in outputs] + [c.alias(name) for name, c in outputs.items()]
    for step in range(1, horizon + 1):
        scored = model.score(state.withColumns(inputs)).select(*kept)
        if step == horizon:
            state = scored
            break
        # Written because the totals read it twice, and because the expressions of chained steps would grow without end.
        scored = cut_lineage(scored)
        if shared:
            totals = scored.groupBy(*group).agg(F.coalesce(F.sum("fed"), F.lit(0.0)).alias("grp_fed"))
            joined = scored.join(F.broadcast(totals) if few else totals, group, "left")
            state = _remember(joined, grain, needed, F.col("grp_fed") - F.col("fed")).drop("grp_fed")
        else:
            state = _remember(scored, grain, needed, F.lit(0.0))
    keys = [c for c in ("scenario", "sku") if c in state.columns]
    return finish(state.select(*keys, F.inline("out")), quantiles)


def seasonal_naive_direct(panel: DataFrame, grain: Grain, horizon: int, quantiles: str = "sorted") -> DataFrame:
    """The joint seasonal naive forecast of any horizon in one plan.

    Feeding p50 back only repeats the last season, so step h is its ((h - 1) mod season) + 1-th row; no loop is needed.
    For panels without missing quantities.
    """
    season = grain.season
    newest = Window.partitionBy("sku").orderBy(F.col("date").desc())
    rows = panel.select("sku", "date", "qty").withColumns(
        {grain.season_column: lagged("qty", season), "age": F.row_number().over(newest)}
    )
    season_rows = F.when(F.col("age") <= season, F.struct("age", "qty"))
    residual = F.col("qty") - F.col(grain.season_column)
    ends = rows.groupBy("sku").agg(
        F.array_sort(F.collect_list(season_rows))["qty"].alias("recent"),
        F.percentile(residual, F.array(F.lit(0.1), F.lit(0.9))).alias("r"),
    )
    start = panel.agg(F.max("date").alias("d")).scalar()
    steps = ends.select("sku", "recent", "r", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    back = F.lit(season - 1) - (F.col("step") - 1) % season
    forecast = steps.select(
        step_date(start, F.col("step"), grain).alias("date"),
        "sku",
        F.lit(0).alias("promo_flag"),
        F.get("recent", back).alias(grain.season_column),
        F.get("r", F.lit(0)).alias("r10"),
        F.get("r", F.lit(1)).alias("r90"),
    )
    return finish(forecast.withColumns(seasonal_quantiles(grain.season_column)), quantiles)


def finish(forecast: DataFrame, quantiles: str = "sorted") -> DataFrame:
    """Order the quantiles unless ``raw``, set negative values to 0 and round to 2 digits."""
    raw = {q: F.col(q) for q in QUANTILES}
    ordered = sorted_quantiles(**raw) if quantiles == "sorted" else raw
    forecast = forecast.withColumns({q: clip_and_round(c) for q, c in ordered.items()})
    keys = [c for c in ("scenario",) if c in forecast.columns]
    return forecast.select(*keys, "date", "sku", "promo_flag", *QUANTILES)


def feed_back(panel: DataFrame, forecast: DataFrame) -> DataFrame:
    """Fill a panel's missing quantities with the forecast's p50 of the same SKU and date."""
    known = forecast.select("sku", "date", F.col("p50").alias("p50_fed"))
    joined = panel.join(known, ["sku", "date"], "left")
    return joined.withColumn("qty", F.coalesce("qty", "p50_fed")).drop("p50_fed")


def future_stubs(panel: DataFrame, grain: Grain, plan: DataFrame | None = None, joint: bool = True) -> DataFrame:
    """Panel rows of the next period: every SKU with its oldest category, no quantity, the planned promotion."""
    ends = panel.groupBy("sku").agg(F.min_by("category", "date").alias("category"), F.max("date").alias("last"))
    if joint:
        ends = ends.withColumn("last", panel.agg(F.max("date").alias("d")).scalar())
    stubs = ends.withColumn("date", step_date(F.col("last"), 1, grain)).drop("last")
    return attach_plan(stubs, plan).withColumn("qty", F.lit(None).cast("double"))


def with_stubs(panel: DataFrame, stubs: DataFrame) -> DataFrame:
    """History and stubs in one panel; the columns a stub lacks are NULL."""
    return panel.unionByName(stubs, allowMissingColumns=True)
