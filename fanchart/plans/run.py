"""The whole chain: normalise, search (optional), train, forecast, write."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from fanchart.grain import grain as grain_of
from fanchart.models.base import QuantileModel
from fanchart.models.closed_form import SeasonalNaive
from fanchart.functions.dates import ISO_FORMATS
from fanchart.models.ensemble import QuantileEnsemble, QuantileEnsembleModel, write_report
from fanchart.models.quantile_gbt import QuantileGBT
from fanchart.operators.backtest import prepare_features
from fanchart.operators.features import add_features
from fanchart.operators.forecast import recursive_forecast
from fanchart.operators.panel import keep_lookback, require_unique_key
from fanchart.operators.search import fit_best, guided_search, random_search, search_ranges
from fanchart.operators.series import export_table
from fanchart.plans.manifest import forget, input_version, run_stage, version_of
from fanchart.session import drop_path
from fanchart.sources.params import load_best_params, write_best_params, write_trials
from fanchart.sources.sales import read_panel, read_promo_plan, write_csv, write_forecast, write_normalised


# Trees per quantile of the two tree experts.
ROUNDS = {"onehot": 800, "target": 1200}
# Settings that the panel depends on, and those that concern neither a search nor a training.
PANEL_SETTINGS = ("freq", "date_formats", "roll_up")
FORECAST_SETTINGS = (
    "input_path", "output_path", "resume", "calibrate_once", "quantiles", "joint", "calibrate_last_k", "clip_low",
    "clip_high", "promo_path",
)


@dataclass(frozen=True)
class RunConfig:
    """Settings of one run; paths may be on any file system Spark reads."""

    input_path: str
    output_path: str
    freq: str = "monthly"
    horizon: int = 12
    folds: int = 3
    eta: float = 5.0
    weighting: str = "equal"
    lookback_months: int | None = None
    halflife: int | None = 18
    search: tuple[str, ...] = ()
    search_folds: int = 4
    trials: int = 50
    search_round_scale: int = 1
    # Draws guided by finished trials, or "random". A guided search that was stopped goes on from its log.
    sampler: str = "guided"
    # Trees per quantile; None takes each encoding's own number.
    rounds: int | None = None
    date_formats: tuple[str, ...] = ISO_FORMATS
    # Read daily sales and roll them up to months first.
    roll_up: bool = False
    calibrate_once: bool = False
    quantiles: str = "sorted"
    joint: bool = True
    calibrate_last_k: int = 6
    clip_low: float = 0.6
    clip_high: float = 1.4
    promo_path: str | None = None
    # Record finished stages, and skip those that an earlier run with the same input and settings finished.
    resume: bool = False


def panel_version(spark: SparkSession, config: RunConfig) -> str | None:
    """Version of the panel for the record of stages; None if nothing is recorded."""
    if not config.resume:
        return None
    return version_of(input_version(spark, config.input_path), [getattr(config, name) for name in PANEL_SETTINGS])


def training_version(spark: SparkSession, config: RunConfig, stage: str) -> str | None:
    """Version of a search or training; None if nothing is recorded."""
    settings = {name: value for name, value in asdict(config).items() if name not in FORECAST_SETTINGS}
    panel = panel_version(spark, config)
    return panel and version_of(stage, panel, settings)


def search_and_save(spark: SparkSession, config: RunConfig, features: DataFrame, encoding: str) -> None:
    """Search one tree expert, write its trials and best parameters, fit it on all rows and save it, unless finished."""
    stage = f"search_{encoding}_{config.freq}"
    version = training_version(spark, config, stage)
    if run_stage(spark, config.output_path, stage, version, lambda: _search(spark, config, features, encoding, version)):
        # A training takes the parameters that a search left.
        forget(spark, config.output_path, f"train_{config.freq}")


def _search(spark: SparkSession, config: RunConfig, features: DataFrame, encoding: str, version: str | None) -> None:
    grain = grain_of(config.freq)
    expert = QuantileGBT(featureCols=grain.feature_columns(), encoding=encoding)
    if config.sampler not in ("guided", "random"):
        raise ValueError("sampler must be guided or random")
    name = f"{encoding}_{config.freq}"
    settings = {"trials": config.trials, "k": config.search_folds, "horizon": config.horizon}
    ranges = search_ranges(encoding, config.search_round_scale)
    if config.sampler == "guided":
        # Trials on other sales or settings are no trials of this search.
        log = f"{config.output_path}/search_batches_{name}" + (f"_{version[:16]}" if version else "")
        found = guided_search(expert, features, grain, ranges, **settings, log_path=log)
    else:
        found = random_search(expert, features, grain, ranges, **settings)
    write_trials(found.trials, f"{config.output_path}/search_trials_{name}")
    # The trials are written whole; a later run, with newer sales perhaps, searches anew.
    if config.sampler == "guided":
        drop_path(spark, log)
    write_best_params(spark, found.best, f"{config.output_path}/best_params_{name}")
    model = fit_best(expert, features, found.best)
    model.write().overwrite().save(f"{config.output_path}/model_{name}_best")


def train(spark: SparkSession, config: RunConfig, panel: DataFrame) -> QuantileModel:
    """The ensemble, fitted with tuned parameters where a search left some, saved with its report; loaded if finished."""
    stage, fitted = f"train_{config.freq}", []
    version = training_version(spark, config, stage)
    run_stage(spark, config.output_path, stage, version, lambda: fitted.append(_train(spark, config, panel)))
    return fitted[0] if fitted else load_model(spark, config)


def _train(spark: SparkSession, config: RunConfig, panel: DataFrame) -> QuantileModel:
    grain = grain_of(config.freq)
    recent = keep_lookback(panel, config.lookback_months, grain)
    features = prepare_features(add_features(recent, grain), grain)
    for encoding in config.search:
        search_and_save(spark, config, features, encoding)
    experts = []
    for encoding in ("onehot", "target"):
        tuned = load_best_params(spark, f"{config.output_path}/best_params_{encoding}_{config.freq}") or {}
        settings = {"rounds": config.rounds or ROUNDS[encoding], **tuned}
        experts.append((encoding, QuantileGBT(featureCols=grain.feature_columns(), encoding=encoding, **settings)))
    experts.append(("snaive", SeasonalNaive(freq=config.freq)))
    ensemble = QuantileEnsemble(
        experts=experts,
        freq=config.freq,
        halflife=config.halflife or 0,
        weighting=config.weighting,
        eta=config.eta,
        folds=config.folds,
        horizon=config.horizon,
    )
    model = ensemble.fit(features)
    model.write().overwrite().save(f"{config.output_path}/model_ensemble_{config.freq}")
    write_report(model.report, f"{config.output_path}/ensemble_report_{config.freq}")
    return model


def load_panel(spark: SparkSession, config: RunConfig) -> DataFrame:
    """The input as a written panel, checked."""
    if config.roll_up and config.freq != "monthly":
        raise ValueError("roll_up makes a monthly panel")
    target, stage = f"{config.output_path}/panel_{config.freq}", f"panel_{config.freq}"

    def work() -> None:
        grain = grain_of(config.freq)
        require_unique_key(write_normalised(spark, config.input_path, target, grain, config.date_formats, config.roll_up))

    run_stage(spark, config.output_path, stage, panel_version(spark, config), work)
    return read_panel(spark, target)


def search(spark: SparkSession, config: RunConfig) -> None:
    """Only the search: trials, best parameters and fitted experts of ``config.search`` are written."""
    grain = grain_of(config.freq)
    recent = keep_lookback(load_panel(spark, config), config.lookback_months, grain)
    features = prepare_features(add_features(recent, grain), grain)
    for encoding in config.search:
        search_and_save(spark, config, features, encoding)


def load_model(spark: SparkSession, config: RunConfig) -> QuantileModel:
    """The ensemble that a training run saved."""
    return QuantileEnsembleModel.load(f"{config.output_path}/model_ensemble_{config.freq}")


def run(spark: SparkSession, config: RunConfig) -> DataFrame:
    """Run every step and return the forecast, which is also written with its export table.

    With ``resume``, the panel, each search and the training are recorded when finished, and a run that is started again
    on the same files and settings goes on behind the last of them. The forecast itself is always made.
    """
    panel = load_panel(spark, config)
    return forecast(spark, config, panel, train(spark, config, panel))


def forecast_saved(spark: SparkSession, config: RunConfig) -> DataFrame:
    """Forecast from the saved ensemble without training, for example with a new plan or newer sales."""
    return forecast(spark, config, load_panel(spark, config), load_model(spark, config))


def forecast(spark: SparkSession, config: RunConfig, panel: DataFrame, model: QuantileModel) -> DataFrame:
    """Forecast with ``model``, write the forecast and its export table, and return it."""
    grain = grain_of(config.freq)
    plan = read_promo_plan(spark, config.promo_path, grain, config.date_formats) if config.promo_path else None
    found = recursive_forecast(
        panel,
        model,
        grain,
        config.horizon,
        plan=plan,
        joint=config.joint,
        calibrate_last_k=config.calibrate_last_k,
        clip_low=config.clip_low,
        clip_high=config.clip_high,
        calibrate_once=config.calibrate_once,
        quantiles=config.quantiles,
    )
    write_forecast(found, f"{config.output_path}/forecast_{config.freq}")
    write_csv(export_table(found, panel), f"{config.output_path}/forecast_export_{config.freq}")
    return found
