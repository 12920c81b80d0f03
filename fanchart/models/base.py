"""The contract of a quantile expert.

``fit`` gives a :class:`QuantileModel`. Its ``transform`` adds p10, p50 and p90. It works in two steps, so that the
horizon loop joins side tables once instead of once per step: ``attach`` joins what the model knows per SKU or
category, ``score`` is row-local.
"""

from __future__ import annotations

import json
from abc import abstractmethod

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReader,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame, SparkSession, types as T

from fanchart.schema import QUANTILES

__all__ = ["HasPanelParams", "QuantileEstimator", "QuantileModel", "keyword_only", "text_columns"]


class HasPanelParams(Params):
    """Parameters every expert has."""

    labelCol = Param(Params._dummy(), "labelCol", "target column", TypeConverters.toString)
    weightCol = Param(Params._dummy(), "weightCol", "row weight column, empty for none", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(labelCol="qty", weightCol="")


class QuantileEstimator(Estimator, HasPanelParams):
    """Base of the experts' estimators; ``copy`` keeps every parameter."""

    def settings(self) -> dict:
        return {p.name: self.getOrDefault(p) for p in self.params if self.isDefined(p)}


class _Writer(MLWriter):
    def __init__(self, model):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(
            self.model, path, self.sparkSession, extraMetadata={"state": json.dumps(self.model._state())}
        )
        self.model._save_parts(path)


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls._restore(self.sparkSession, path, json.loads(metadata["state"]))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class QuantileModel(Model, HasPanelParams, MLWritable, MLReadable):
    """A fitted expert, saved and loaded like any Spark ML model."""

    def attach(self, df: DataFrame) -> DataFrame:
        """Join the model's side tables; nothing by default."""
        return df

    @abstractmethod
    def score(self, df: DataFrame) -> DataFrame:
        """Add p10, p50, p90 to a frame that went through :meth:`attach`; row-local."""

    def side_columns(self) -> list[str]:
        """Columns :meth:`attach` adds."""
        return []

    @abstractmethod
    def input_columns(self) -> list[str]:
        """Columns :meth:`score` reads besides the side columns."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.score(self.attach(df)).select(*df.columns, *QUANTILES)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)

    def _state(self) -> dict:
        """Small values that go into the metadata."""
        return {}

    def _save_parts(self, path: str) -> None:
        """Write side tables and nested models under ``path``."""

    @classmethod
    def _restore(cls, spark: SparkSession, path: str, state: dict):
        raise NotImplementedError


def text_columns(df: DataFrame, features: list[str], named: list[str]) -> list[str]:
    """Categorical features: the named ones and every text column."""
    is_text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return [c for c in features if c in named or c in is_text]
