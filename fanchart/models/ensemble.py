"""Several experts as one: mean of their quantiles, equal or weighted by walk-forward loss."""

from __future__ import annotations

import importlib
import math
from datetime import datetime, timezone

from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import Column, DataFrame, Window, functions as F

from fanchart.grain import grain as grain_of
from fanchart.models.base import QuantileEstimator, QuantileModel, keyword_only, text_columns
from fanchart.operators.backtest import mean_scores, walk_forward
from fanchart.operators.weights import add_training_weight
from fanchart.schema import QUANTILES

# Fixed value: the loss that exponential weights use. It is free of scale, so eta means the same for every panel.
WEIGHT_LOSS = "wMAPE"


def exponential_weights(losses: DataFrame, eta: float, loss: str = "loss") -> DataFrame:
    """Add ``weight`` = exp(-eta * loss) over the sum of all, from one row per expert.

    Losses are taken relative to the smallest, which leaves the weights as they are and keeps exp from underflowing.
    The window over everything holds one row per expert.
    """
    everyone = Window.partitionBy(F.lit(0))
    raw = F.exp(-eta * (F.col(loss) - F.min(loss).over(everyone)))
    return losses.withColumn("raw", raw).withColumn("weight", F.col("raw") / F.sum("raw").over(everyone)).drop("raw")


def mean_of_experts(forecasts: DataFrame, keys: list[str], weights: DataFrame | None = None) -> DataFrame:
    """One forecast per ``keys`` from rows (keys, expert, p10, p50, p90): equal mean, or weighted by (expert, weight)."""
    if weights is None:
        return forecasts.groupBy(*keys).agg(*[F.avg(q).alias(q) for q in QUANTILES])
    # One row per expert, so the broadcast is bounded.
    joined = forecasts.join(F.broadcast(weights.select("expert", "weight")), "expert")
    total = F.sum("weight")
    return joined.groupBy(*keys).agg(*[(F.sum(F.col(q) * F.col("weight")) / total).alias(q) for q in QUANTILES])


class QuantileEnsemble(QuantileEstimator):
    """Fits every expert on all rows, with half-life and out-of-stock weights, and averages their quantiles.

    ``weighting`` is ``equal`` (default) or ``exp``, which scores each expert by walk-forward first.
    """

    freq = Param(Params._dummy(), "freq", "monthly or daily", TypeConverters.toString)
    halflife = Param(Params._dummy(), "halflife", "periods until a weight halves, 0 for none", TypeConverters.toInt)
    weighting = Param(Params._dummy(), "weighting", "equal or exp", TypeConverters.toString)
    eta = Param(Params._dummy(), "eta", "how hard exp weights punish losses", TypeConverters.toFloat)
    folds = Param(Params._dummy(), "folds", "walk-forward folds", TypeConverters.toInt)
    horizon = Param(Params._dummy(), "horizon", "periods per fold", TypeConverters.toInt)

    @keyword_only
    def __init__(
        self,
        *,
        experts: list[tuple[str, QuantileEstimator]] | None = None,
        freq: str = "monthly",
        halflife: int = 0,
        weighting: str = "equal",
        eta: float = 5.0,
        folds: int = 3,
        horizon: int = 12,
        labelCol: str = "qty",
        weightCol: str = "weight",
    ):
        super().__init__()
        self._setDefault(
            freq="monthly", halflife=0, weighting="equal", eta=5.0, folds=3, horizon=12, weightCol="weight"
        )
        kwargs = dict(self._input_kwargs)
        self.experts = kwargs.pop("experts", None) or []
        self._set(**kwargs)

    def copy(self, extra=None):
        other = super().copy(extra)
        other.experts = [(name, expert.copy(extra)) for name, expert in self.experts]
        return other

    def _fit(self, df: DataFrame) -> QuantileEnsembleModel:
        p = self.settings()
        calendar = grain_of(p["freq"])
        if p["weighting"] not in ("equal", "exp"):
            raise ValueError("weighting must be equal or exp")
        if not self.experts:
            raise ValueError("an ensemble needs an expert")
        weighted = add_training_weight(df, calendar, p["halflife"] or None, p["weightCol"])
        shares = {name: 1.0 / len(self.experts) for name, _ in self.experts}
        if p["weighting"] == "exp":
            shares = self._shares(df, calendar, p)
        fitted = []
        for name, expert in self.experts:
            if not isinstance(expert, QuantileEstimator):
                raise TypeError(f"expert {name!r} is not a QuantileEstimator")
            own = {expert.weightCol: p["weightCol"], expert.labelCol: p["labelCol"]}
            fitted.append((name, expert.copy(own).fit(weighted)))
        model = self._copyValues(QuantileEnsembleModel(fitted, shares))
        model.report = training_report(df, p, self.experts)
        return model

    def _shares(self, df: DataFrame, calendar, p: dict) -> dict[str, float]:
        """Expert weights from walk-forward losses: one number per expert reaches the driver."""
        losses = {}
        for name, expert in self.experts:
            row = mean_scores(walk_forward(expert, df, calendar, p["folds"], p["horizon"])).first()
            if not row["n_folds"]:
                raise NoValidFoldError("no fold has enough rows to weight the experts")
            losses[name] = row[WEIGHT_LOSS]
        least = min(losses.values())
        raw = {name: math.exp(-p["eta"] * (loss - least)) for name, loss in losses.items()}
        return {name: r / sum(raw.values()) for name, r in raw.items()}


class NoValidFoldError(ValueError):
    """No fold could be scored, so nothing can be compared."""


def training_report(df: DataFrame, settings: dict, experts: list[tuple[str, QuantileEstimator]]) -> DataFrame:
    """One row about a training: settings, size and date range of the data, and the experts."""
    described = []

    def names(columns: list[str] | None) -> Column:
        return F.array(*map(F.lit, columns)) if columns else F.lit(None).cast("array<string>")

    for name, expert in experts:
        own = expert.settings()
        columns = own.get("featureCols")
        categorical = text_columns(df, columns, own.get("catCols") or []) if columns else None
        # Fixed names: fields of the report.
        described.append(
            F.struct(
                F.lit(name).alias("name"),
                F.lit(type(expert).__name__).alias("class"),
                names(columns).alias("feature_names"),
                names(categorical).alias("cat_cols"),
            )
        )
    size = df.agg(F.count("*").alias("rows"), F.min("date").alias("date_min"), F.max("date").alias("date_max"))
    return size.select(
        F.lit(datetime.now(timezone.utc).isoformat()).alias("generated_at"),
        F.lit(settings["freq"]).alias("freq"),
        F.lit(settings["eta"]).alias("eta"),
        F.lit(settings["halflife"] or None).cast("int").alias("halflife"),
        "rows",
        F.lit(len(df.columns)).alias("features_total"),
        F.lit(settings["labelCol"]).alias("y_col"),
        "date_min",
        "date_max",
        F.lit(settings["folds"]).alias("cv_folds"),
        F.lit(settings["horizon"]).alias("horizon"),
        F.array(*described).alias("experts"),
    )


def write_report(report: DataFrame, path: str) -> None:
    """A training report as one JSON object."""
    report.coalesce(1).write.mode("overwrite").json(path)


class QuantileEnsembleModel(QuantileModel):
    def __init__(self, fitted: list[tuple[str, QuantileModel]] | None = None, shares: dict[str, float] | None = None):
        super().__init__()
        self.fitted = fitted or []
        self.shares = shares or {}
        self.report = None

    def attach(self, df: DataFrame) -> DataFrame:
        for name, expert in self.fitted:
            df = expert.attach(df)
            df = df.withColumnsRenamed({c: f"{name}__{c}" for c in expert.side_columns()})
        return df

    def side_columns(self) -> list[str]:
        return [f"{name}__{c}" for name, expert in self.fitted for c in expert.side_columns()]

    def input_columns(self) -> list[str]:
        return sorted({c for _, expert in self.fitted for c in expert.input_columns()})

    def score(self, df: DataFrame) -> DataFrame:
        kept = [c for c in df.columns if c not in QUANTILES]
        for name, expert in self.fitted:
            own = {f"{name}__{c}": c for c in expert.side_columns()}
            df = expert.score(df.withColumnsRenamed(own))
            back = {c: long for long, c in own.items()}
            df = df.withColumnsRenamed({**back, **{q: f"{name}__{q}" for q in QUANTILES}})
        return df.select(*kept, *[self._mean(q).alias(q) for q in QUANTILES])

    def _mean(self, q: str) -> Column:
        parts = [F.col(f"{name}__{q}") for name, _ in self.fitted]
        if len(set(self.shares.values())) == 1:
            return sum(parts[1:], parts[0]) / float(len(parts))
        weighted = [part * self.shares[name] for part, (name, _) in zip(parts, self.fitted)]
        return sum(weighted[1:], weighted[0])

    def _state(self) -> dict:
        kinds = [(name, type(m).__module__, type(m).__name__) for name, m in self.fitted]
        return {"experts": kinds, "shares": self.shares}

    def _save_parts(self, path: str) -> None:
        for name, expert in self.fitted:
            expert.save(f"{path}/expert_{name}")

    @classmethod
    def _restore(cls, spark, path, state):
        fitted = []
        for name, module, kind in state["experts"]:
            expert = getattr(importlib.import_module(module), kind)
            fitted.append((name, expert.load(f"{path}/expert_{name}")))
        return cls(fitted, state["shares"])
