"""Experts without a training loop: seasonal naive, constant quantiles, last value."""

from __future__ import annotations

from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame, functions as F

from fanchart.functions.quantiles import percentiles
from fanchart.grain import grain as grain_of
from fanchart.models.base import QuantileEstimator, QuantileModel, keyword_only
from fanchart.schema import QUANTILES
from fanchart.session import small_side


def residual_summary(train: DataFrame, lag_column: str, label: str = "qty", keys: tuple[str, ...] = ("sku",)):
    """What the seasonal error of a SKU looks like: its p10 and p90 (r10, r90) and its mean size (scale).

    Only rows that have both values count. Keys include the SKU, so a group is no longer than the calendar and the
    built-in percentile is bounded.
    """
    residual = F.col(label) - F.col(lag_column)
    return (
        train.filter(residual.isNotNull())
        .groupBy(*keys)
        .agg(
            F.percentile(residual, F.array(F.lit(0.1), F.lit(0.9))).alias("r"),
            F.avg(F.abs(residual)).alias("scale"),
        )
        .select(*keys, F.get("r", F.lit(0)).alias("r10"), F.get("r", F.lit(1)).alias("r90"), "scale")
    )


def seasonal_quantiles(lag_column: str) -> dict[str, object]:
    """The seasonal lag as p50, shifted by the residual quantiles; what is missing counts as 0."""
    base = F.coalesce(F.col(lag_column), F.lit(0.0))
    return {
        "p10": base + F.coalesce("r10", F.lit(0.0)),
        "p50": base,
        "p90": base + F.coalesce("r90", F.lit(0.0)),
    }


class SeasonalNaive(QuantileEstimator):
    """p50 is the value one season ago, p10 and p90 add the SKU's residual quantiles. Weights are not used."""

    freq = Param(Params._dummy(), "freq", "monthly or daily", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, freq: str = "monthly", labelCol: str = "qty", weightCol: str = ""):
        super().__init__()
        self._setDefault(freq="monthly")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> SeasonalNaiveModel:
        column = grain_of(self.getOrDefault(self.freq)).season_column
        if column not in df.columns:
            raise ValueError(f"features lack {column}")
        residuals = residual_summary(df, column, self.getOrDefault(self.labelCol)).drop("scale")
        model = SeasonalNaiveModel(small_side(residuals), column)
        return self._copyValues(model)


class SeasonalNaiveModel(QuantileModel):
    freq = SeasonalNaive.freq

    def __init__(self, residuals: DataFrame | None = None, season_column: str = "y_lag12"):
        super().__init__()
        self.residuals = residuals
        self.season_column = season_column

    def attach(self, df: DataFrame) -> DataFrame:
        return df.join(self.residuals, "sku", "left")

    def side_columns(self) -> list[str]:
        return ["r10", "r90"]

    def input_columns(self) -> list[str]:
        return [self.season_column]

    def score(self, df: DataFrame) -> DataFrame:
        return df.withColumns(seasonal_quantiles(self.season_column))

    def _state(self) -> dict:
        return {"season_column": self.season_column}

    def _save_parts(self, path: str) -> None:
        self.residuals.write.parquet(f"{path}/residuals")

    @classmethod
    def _restore(cls, spark, path, state):
        return cls(spark.read.parquet(f"{path}/residuals"), state["season_column"])


class ConstantQuantile(QuantileEstimator):
    """The training quantiles of the target, for every row; with ``weighted``, quantiles by cumulative weight."""

    weighted = Param(Params._dummy(), "weighted", "whether weightCol counts", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, labelCol: str = "qty", weightCol: str = "", weighted: bool = False):
        super().__init__()
        self._setDefault(weighted=False)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> ConstantQuantileModel:
        weight = self.getOrDefault(self.weightCol) if self.getOrDefault(self.weighted) else ""
        values = percentiles(df, self.getOrDefault(self.labelCol), QUANTILES, weight)
        return self._copyValues(ConstantQuantileModel(values))


class ConstantQuantileModel(QuantileModel):
    def __init__(self, values: dict[str, float] | None = None):
        super().__init__()
        self.values = values or {}

    def input_columns(self) -> list[str]:
        return []

    def score(self, df: DataFrame) -> DataFrame:
        return df.withColumns({name: F.lit(value) for name, value in self.values.items()})

    def _state(self) -> dict:
        return self.values

    @classmethod
    def _restore(cls, spark, path, state):
        return cls(state)


class LastValue(QuantileEstimator):
    """The SKU's last value as p10, p50 and p90; 0 for a SKU the training rows lack."""

    @keyword_only
    def __init__(self, *, labelCol: str = "qty", weightCol: str = ""):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> LastValueModel:
        label = self.getOrDefault(self.labelCol)
        last = df.groupBy("sku").agg(F.max_by(label, F.when(F.col(label).isNotNull(), F.col("date"))).alias("last_y"))
        return self._copyValues(LastValueModel(small_side(last)))


class LastValueModel(QuantileModel):
    def __init__(self, last: DataFrame | None = None):
        super().__init__()
        self.last = last

    def attach(self, df: DataFrame) -> DataFrame:
        return df.join(self.last, "sku", "left")

    def side_columns(self) -> list[str]:
        return ["last_y"]

    def input_columns(self) -> list[str]:
        return []

    def score(self, df: DataFrame) -> DataFrame:
        return df.withColumns({name: F.coalesce("last_y", F.lit(0.0)) for name in QUANTILES})

    def _save_parts(self, path: str) -> None:
        self.last.write.parquet(f"{path}/last")

    @classmethod
    def _restore(cls, spark, path, state):
        return cls(spark.read.parquet(f"{path}/last"))
