"""Boosted quantile trees on Spark ML's decision trees.

After Friedman (2001): start at the training quantile; each round fits a regression tree to the gradient of the
pinball loss, sets every leaf to the quantile of its residuals and moves a step of the learning rate. Spark ML grows
the trees; the leaf quantiles are a few aggregates per round.
"""

from __future__ import annotations

import math
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressionModel
from pyspark.ml.wrapper import JavaWrapper
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from fanchart.functions.quantiles import number_array, percentiles, weighted_quantiles
from fanchart.models.base import QuantileEstimator, QuantileModel, keyword_only, text_columns
from fanchart.schema import QUANTILES
from fanchart.session import cut_lineage, drop_written, scratch_path, small_side

# Below this many training rows no tree is grown and the model predicts the training quantiles.
FEWEST_ROWS = 4
# Pseudo-rows of the overall mean that a category's target mean starts with.
PRIOR_ROWS = 1.0


def encoded(column: str) -> str:
    return f"{column}__target"


def softened(min_leaf: int, depth: int, n: int) -> tuple[int, int]:
    """Leaf size and depth that a training set of ``n`` rows can carry."""
    return max(1, min(min_leaf, n // 10)), max(1, min(depth, int(math.log2(max(2, n - 1)))))


def _sums(label: str, weight: str) -> list[Column]:
    """Weighted sum of the target as s and its weight as c; every row weighs 1 without a weight column."""
    w = F.when(F.col(label).isNotNull(), F.col(weight) if weight else F.lit(1.0))
    return [F.sum(F.col(label) * w).alias("s"), F.sum(w).alias("c")]


def target_means_by_date(train: DataFrame, column: str, label: str, weight: str = "") -> DataFrame:
    """Weighted mean target of a category before each date, as (column, date, code).

    Sums per (category, date) come first, so the running window sees at most one row per date of a category, however
    many rows the category has. Before a category's first date the overall mean up to then stands in; it has one row
    per date, so its broadcast is bounded by the calendar.
    """
    daily = train.groupBy(column, "date").agg(*_sums(label, weight))
    earlier = Window.partitionBy(column).orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    prior = overall_mean_by_date(train, label, weight)
    runs = daily.select(
        column,
        "date",
        F.coalesce(F.sum("s").over(earlier), F.lit(0.0)).alias("s"),
        F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("c"),
    ).join(F.broadcast(prior), "date")
    mean = (F.col("s") + PRIOR_ROWS * F.col("prior")) / (F.col("c") + PRIOR_ROWS)
    return runs.select(column, "date", mean.alias("code"))


def overall_mean_by_date(train: DataFrame, label: str, weight: str = "") -> DataFrame:
    """Weighted mean target of all rows before each date (0 on the first), as (date, prior).

    The window runs over one row per date, so the calendar bounds it, whatever the number of rows.
    """
    dates = train.groupBy("date").agg(*_sums(label, weight))
    earlier = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    return dates.select("date", F.coalesce(F.try_divide(F.sum("s").over(earlier), F.sum("c").over(earlier)), F.lit(0.0)).alias("prior"))


def overall_mean(train: DataFrame, label: str, weight: str = "") -> float:
    s, c = train.agg(*_sums(label, weight)).first()
    return float(s) / c if c else 0.0


def target_means(train: DataFrame, column: str, label: str, weight: str = "") -> DataFrame:
    """Weighted mean target of a category over all training rows, as (column, code), for rows after the training dates."""
    overall = overall_mean(train, label, weight)
    sums = train.groupBy(column).agg(*_sums(label, weight)).na.fill(0, ["s", "c"])
    return sums.select(column, ((F.col("s") + PRIOR_ROWS * overall) / (F.col("c") + PRIOR_ROWS)).alias(encoded(column)))


class QuantileGBT(QuantileEstimator):
    """Boosted trees for p10, p50 and p90.

    ``encoding`` is how categories enter the trees: ``onehot`` makes one column per value, ``target`` the mean of the
    category's earlier targets. ``oneHotCols`` and ``targetCols`` name columns that are coded the one or the other way
    whatever ``encoding`` says. The choice never depends on the data. The trees' statistics grow with the number of
    one-hot columns, so a column with very many values is best named in ``targetCols``.
    """

    featureCols = Param(Params._dummy(), "featureCols", "model inputs", TypeConverters.toListString)
    catCols = Param(Params._dummy(), "catCols", "categorical inputs besides text columns", TypeConverters.toListString)
    encoding = Param(Params._dummy(), "encoding", "onehot or target", TypeConverters.toString)
    oneHotCols = Param(Params._dummy(), "oneHotCols", "always one column per value", TypeConverters.toListString)
    targetCols = Param(Params._dummy(), "targetCols", "always the mean of earlier targets", TypeConverters.toListString)
    quantiles = Param(Params._dummy(), "quantiles", "quantiles to fit", TypeConverters.toListString)
    rounds = Param(Params._dummy(), "rounds", "trees per quantile", TypeConverters.toInt)
    learningRate = Param(Params._dummy(), "learningRate", "step per tree", TypeConverters.toFloat)
    maxDepth = Param(Params._dummy(), "maxDepth", "tree depth", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "fewest rows in a leaf", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "split candidates per column", TypeConverters.toInt)
    checkpointInterval = Param(Params._dummy(), "checkpointInterval", "rounds between writes", TypeConverters.toInt)
    parallelism = Param(Params._dummy(), "parallelism", "quantiles fitted at a time", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "random seed", TypeConverters.toInt)

    @keyword_only
    def __init__(
        self,
        *,
        featureCols: list[str] | None = None,
        catCols: list[str] | None = None,
        encoding: str | None = None,
        oneHotCols: list[str] | None = None,
        targetCols: list[str] | None = None,
        quantiles: list[str] | None = None,
        rounds: int | None = None,
        learningRate: float | None = None,
        maxDepth: int | None = None,
        minInstancesPerNode: int | None = None,
        maxBins: int | None = None,
        checkpointInterval: int | None = None,
        parallelism: int | None = None,
        seed: int | None = None,
        labelCol: str | None = None,
        weightCol: str | None = None,
    ):
        super().__init__()
        self._setDefault(
            featureCols=[],
            catCols=[],
            encoding="onehot",
            oneHotCols=[],
            targetCols=[],
            quantiles=list(QUANTILES),
            rounds=20,
            learningRate=0.2,
            maxDepth=5,
            minInstancesPerNode=50,
            maxBins=32,
            checkpointInterval=5,
            parallelism=3,
            seed=42,
        )
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> QuantileGBTModel:
        p = self.settings()
        label, features = p["labelCol"], p["featureCols"]
        if p["encoding"] not in ("onehot", "target"):
            raise ValueError("encoding must be onehot or target")
        categorical = text_columns(df, features, p["catCols"])
        if both := set(p["oneHotCols"]) & set(p["targetCols"]):
            raise ValueError(f"columns in both oneHotCols and targetCols: {sorted(both)}")
        default = [c for c in categorical if c not in p["oneHotCols"] and c not in p["targetCols"]]
        by_target = [c for c in categorical if c in p["targetCols"] or c in default and p["encoding"] == "target"]
        one_hot = [c for c in categorical if c not in by_target]
        n = df.agg(F.count(label)).first()[0]

        start = percentiles(df, label, {q: QUANTILES[q] for q in p["quantiles"]}, p["weightCol"])
        rounds = p["rounds"] if n >= FEWEST_ROWS else 0
        if rounds == 0:
            return self._copyValues(QuantileGBTModel(start=start))

        coded = df.filter(F.col(label).isNotNull())
        for c in by_target:
            codes = small_side(target_means_by_date(df, c, label, p["weightCol"]))
            coded = coded.join(codes, [c, "date"], "left").withColumnRenamed("code", encoded(c))
        numeric = [c for c in features if c not in categorical] + [encoded(c) for c in by_target]
        encoder = _assembler(numeric, one_hot).fit(coded)
        weight = F.col(p["weightCol"]) if p["weightCol"] else F.lit(1.0)
        rows = encoder.transform(coded).select("features", F.col(label).alias("y"), weight.cast("double").alias("w"))
        train = spread(cut_lineage(rows)).persist()
        try:
            with ThreadPool(min(p["parallelism"], len(start))) as pool:
                boost = inheritable_thread_target(df.sparkSession)(
                    lambda q: _forest(df.sparkSession, *_boost(train, QUANTILES[q], start[q], rounds, n, p))
                )
                forests = dict(zip(start, pool.map(boost, start)))
        finally:
            train.unpersist()
        model = QuantileGBTModel(
            start=start,
            learning_rate=p["learningRate"],
            forests=forests,
            encoder=encoder,
            codes={c: small_side(target_means(df, c, label, p["weightCol"])) for c in by_target},
            overall=overall_mean(df, label, p["weightCol"]) if by_target else 0.0,
            inputs=features,
        )
        return self._copyValues(model)


def spread(df: DataFrame) -> DataFrame:
    """Use every core: a table in fewer partitions than there are cores is dealt out once."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _assembler(numeric: list[str], one_hot: list[str]) -> Pipeline:
    """Feature vector stages; unseen categories get a column of their own and NULL becomes NaN."""
    stages, inputs = [], list(numeric)
    if one_hot:
        index, hot = [f"{c}__index" for c in one_hot], [f"{c}__hot" for c in one_hot]
        stages.append(StringIndexer(inputCols=one_hot, outputCols=index, handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=index, outputCols=hot, handleInvalid="keep"))
        inputs += hot
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"))
    return Pipeline(stages=stages)


def _boost(train: DataFrame, tau: float, start: float, rounds: int, n: int, p: dict):
    """Trees and their leaf values for one quantile. Only leaf values, at most 2**depth per round, reach the driver."""
    min_leaf, depth = softened(p["minInstancesPerNode"], p["maxDepth"], n)
    learner = DecisionTreeRegressor(
        labelCol="slope",
        weightCol="w",
        leafCol="leaf",
        predictionCol="step",
        maxDepth=depth,
        minInstancesPerNode=min_leaf,
        maxBins=p["maxBins"],
        seed=p["seed"],
    )
    current = train.withColumn("fit", F.lit(start))
    trees, leaves = [], []
    for r in range(1, rounds + 1):
        sloped = current.withColumn("slope", F.when(F.col("y") > F.col("fit"), tau).otherwise(tau - 1))
        tree = learner.fit(sloped)
        grown = tree.transform(sloped).withColumn("leaf", F.col("leaf").cast("int"))
        rest = grown.select("leaf", (F.col("y") - F.col("fit")).alias("rest"), "w").persist()
        values = weighted_quantiles(rest, "leaf", "rest", "w", tau)
        rest.unpersist()
        table = [float(values.get(i) or 0.0) for i in range(max(values) + 1)]
        trees.append(tree)
        leaves.append(table)
        if r == rounds:
            break
        moved = F.col("fit") + p["learningRate"] * F.get(number_array(table), F.col("leaf"))
        current = grown.select("features", "y", "w", moved.alias("fit"))
        if r % p["checkpointInterval"] == 0:
            current = cut_lineage(current)
    return trees, leaves


def _forest(spark: SparkSession, trees: list, leaves: list[list[float]]) -> GBTRegressionModel:
    """The trees of one quantile as one Spark ML model whose leaves hold ``leaves``: its prediction is their plain sum.

    The model is saved, the predictions of its leaf nodes are replaced in the saved nodes, and it is loaded again. Leaves
    are numbered by node id, as ``leafCol`` does. Scoring is then one call per row, whatever the number of trees.
    """
    jvm = spark.sparkContext._jvm
    tree_class = jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    nodes = JavaWrapper._new_java_array([t._java_obj for t in trees], tree_class)
    ones = JavaWrapper._new_java_array([1.0] * len(trees), jvm.double)
    name = "org.apache.spark.ml.regression.GBTRegressionModel"
    path = scratch_path(spark)
    GBTRegressionModel(JavaWrapper._new_java_obj(name, f"forest_{trees[0].uid}", nodes, ones)).save(path)
    saved = spark.read.parquet(f"{path}/data")
    # One tree's nodes are at most 2^(depth + 1).
    order = Window.partitionBy("treeID").orderBy("nodeData.id").rowsBetween(Window.unboundedPreceding, 0)
    is_leaf = F.col("nodeData.leftChild") < 0
    numbered = saved.withColumn("leaf", F.when(is_leaf, F.sum(is_leaf.cast("int")).over(order) - 1))
    listed = [(t, i, float(v)) for t, values in enumerate(leaves) for i, v in enumerate(values)]
    values = spark.createDataFrame(listed, "treeID int, leaf bigint, value double")
    held = F.col("nodeData").withField("prediction", F.coalesce("value", "nodeData.prediction"))
    changed = cut_lineage(numbered.join(values, ["treeID", "leaf"], "left").select("treeID", held.alias("nodeData")))
    changed.write.mode("overwrite").parquet(f"{path}/data")
    drop_written(changed)
    return GBTRegressionModel.load(path)


class QuantileGBTModel(QuantileModel):
    """Forests, the encoder and the category means. A quantile that was not fitted is NULL."""

    def __init__(
        self,
        start: dict[str, float] | None = None,
        learning_rate: float = 0.0,
        forests: dict[str, GBTRegressionModel] | None = None,
        encoder: PipelineModel | None = None,
        codes: dict[str, DataFrame] | None = None,
        overall: float = 0.0,
        inputs: list[str] | None = None,
    ):
        super().__init__()
        self.inputs = inputs or []
        self.start = start or {}
        self.learning_rate = learning_rate
        self.forests = forests or {}
        self.encoder = encoder
        self.codes = codes or {}
        self.overall = overall
        for q, forest in self.forests.items():
            forest.setPredictionCol(f"{q}__sum")

    @property
    def is_constant(self) -> bool:
        """True if too few rows were given to grow a tree."""
        return not self.forests

    def attach(self, df: DataFrame) -> DataFrame:
        for column, code in self.codes.items():
            df = df.join(code, column, "left")
        return df

    def side_columns(self) -> list[str]:
        return [encoded(c) for c in self.codes]

    def input_columns(self) -> list[str]:
        return self.inputs

    def score(self, df: DataFrame) -> DataFrame:
        found = {q: F.lit(None).cast("double") for q in QUANTILES}
        found.update({q: F.lit(value) for q, value in self.start.items()})
        kept, scored = df.columns, df
        if not self.is_constant:
            codes = {encoded(c): F.coalesce(encoded(c), F.lit(self.overall)) for c in self.codes}
            scored = self.encoder.transform(df.withColumns(codes) if codes else df)
            for q, forest in self.forests.items():
                scored = forest.transform(scored)
                found[q] = F.lit(self.start[q]) + self.learning_rate * F.col(f"{q}__sum")
        return scored.select(*[c for c in kept if c not in found], *[v.alias(q) for q, v in found.items()])

    def _state(self) -> dict:
        return {
            "start": self.start,
            "learning_rate": self.learning_rate,
            "quantiles": list(self.forests),
            "codes": list(self.codes),
            "overall": self.overall,
            "inputs": self.inputs,
        }

    def _save_parts(self, path: str) -> None:
        for q, forest in self.forests.items():
            forest.save(f"{path}/forest_{q}")
        if self.encoder is not None:
            self.encoder.save(f"{path}/encoder")
        for column, code in self.codes.items():
            code.write.parquet(f"{path}/codes_{column}")

    @classmethod
    def _restore(cls, spark, path, state):
        return cls(
            start=state["start"],
            learning_rate=state["learning_rate"],
            forests={q: GBTRegressionModel.load(f"{path}/forest_{q}") for q in state["quantiles"]},
            encoder=PipelineModel.load(f"{path}/encoder") if state["quantiles"] else None,
            codes={c: spark.read.parquet(f"{path}/codes_{c}") for c in state["codes"]},
            overall=state["overall"],
            inputs=state["inputs"],
        )
