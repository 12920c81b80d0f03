"""Search over an expert's parameters: seeded random draws, or draws guided by the trials done so far.

The guided sampler is a tree-structured Parzen estimator (Bergstra et al. 2011). The finished trials are split into the
best few and the rest; every parameter gets a density over either set, a mixture of bells around the values tried and one
over the whole range; of some values drawn from the density of the best, the one whose ratio of densities is largest is tried.

Trials run in batches, as concurrent Spark jobs. A trial is drawn from the trials of earlier batches and a seed of its own
number, so the log alone decides how a search goes on: a search that was stopped and starts again from its written log
makes the trials it would have made.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from fanchart.grain import Grain
from fanchart.models.base import QuantileEstimator
from fanchart.models.ensemble import NoValidFoldError
from fanchart.operators.backtest import walk_forward
from fanchart.session import path_exists

# Search ranges (low, high).
ONE_HOT_RANGES = {
    "rounds": (300, 1400),
    "maxDepth": (4, 7),
    "learningRate": (0.02, 0.2),
    "minInstancesPerNode": (10, 200),
}
TARGET_RANGES = {
    "rounds": (600, 2500),
    "maxDepth": (4, 8),
    "learningRate": (0.02, 0.2),
}
# Random trials before the first guided one, values drawn per guided parameter, and the share of trials that are the best.
STARTUP, CANDIDATES, BEST_SHARE = 10, 24, 0.15


@dataclass(frozen=True)
class SearchResult:
    """The trial log and the parameters of the trial with the smallest loss."""

    trials: DataFrame
    best: dict


def search_ranges(encoding: str, round_scale: int = 1) -> dict[str, tuple]:
    """The ranges of an encoding; a caller that wants a short search may divide the tree counts."""
    ranges = dict(ONE_HOT_RANGES if encoding == "onehot" else TARGET_RANGES)
    low, high = ranges["rounds"]
    ranges["rounds"] = (max(1, low // round_scale), max(1, high // round_scale))
    return ranges


def draw(ranges: dict[str, tuple], rng: random.Random) -> dict:
    """One parameter set: whole numbers evenly, fractions evenly on the log scale."""
    params = {}
    for name, (low, high) in ranges.items():
        if _whole(low, high):
            params[name] = rng.randint(low, high)
        else:
            params[name] = math.exp(rng.uniform(math.log(low), math.log(high)))
    return params


def _whole(low, high) -> bool:
    return isinstance(low, int) and isinstance(high, int)


class Parzen:
    """Density of one parameter over the values tried, within [low, high]."""

    def __init__(self, values: list[float], low: float, high: float):
        self.low, self.high = low, high
        width = high - low
        self.bells = [(0.5 * (low + high), width)]
        ends = [low, *sorted(values), high]
        for before, value, after in zip(ends, ends[1:], ends[2:]):
            # As wide as the larger gap to a neighbour, but never a needle or wider than the range.
            spread = min(max(value - before, after - value, width / min(100, len(values) + 2)), width)
            self.bells.append((value, spread))

    def draw(self, rng: random.Random) -> float:
        centre, spread = rng.choice(self.bells)
        for _ in range(100):
            value = rng.gauss(centre, spread)
            if self.low <= value <= self.high:
                return value
        return min(max(centre, self.low), self.high)

    def log_density(self, value: float) -> float:
        total = 0.0
        for centre, spread in self.bells:
            inside = _below((self.high - centre) / spread) - _below((self.low - centre) / spread)
            total += math.exp(-0.5 * ((value - centre) / spread) ** 2) / (spread * max(inside, 1e-12))
        return math.log(max(total / len(self.bells), 1e-300))


def _below(z: float) -> float:
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def guided_draw(ranges: dict[str, tuple], done: list[tuple[float, dict]], rng: random.Random, startup: int = STARTUP) -> dict:
    """A parameter set from the finished trials ``done`` (loss, parameters); a random one before ``startup`` of them."""
    if len(done) < max(startup, 2):
        return draw(ranges, rng)
    ordered = [params for _, params in sorted(done, key=lambda trial: trial[0])]
    n_best = max(1, math.ceil(BEST_SHARE * len(ordered)))
    params = {}
    for name, (low, high) in ranges.items():
        whole = _whole(low, high)
        # A whole number stands for the stretch of half a step on either side.
        ends = (low - 0.5, high + 0.5) if whole else (math.log(low), math.log(high))
        if ends[0] == ends[1]:
            params[name] = low
            continue
        values = [float(p[name]) if whole else math.log(p[name]) for p in ordered]
        best, rest = Parzen(values[:n_best], *ends), Parzen(values[n_best:], *ends)
        drawn = [best.draw(rng) for _ in range(CANDIDATES)]
        if whole:
            drawn = [float(min(max(round(v), low), high)) for v in drawn]
        chosen = max(drawn, key=lambda v: best.log_density(v) - rest.log_density(v))
        params[name] = int(chosen) if whole else min(max(math.exp(chosen), low), high)
    return params


def guided_trials(
    evaluate: Callable[[int, dict], float],
    ranges: dict[str, tuple],
    trials: int,
    seed: int = 42,
    batch: int = 2,
    startup: int = STARTUP,
    known: list[tuple[int, float, dict]] = (),
    finished: Callable[[list[tuple[int, float, dict]]], None] = lambda rows: None,
    run_all: Callable = lambda function, items: [function(i) for i in items],
) -> list[tuple[int, float, dict]]:
    """All trials (number, loss, parameters). Whole batches among the ``known`` ones are not run again.

    ``finished`` gets a batch's trials when all are done, and ``run_all`` maps a function over the trials of a batch.
    """
    log = []
    for first in range(0, trials, batch):
        numbers = range(first, min(first + batch, trials))
        old = [t for t in known if t[0] in numbers]
        if len(old) < len(numbers):
            done = [(loss, params) for _, loss, params in log]
            drawn = [(n, guided_draw(ranges, done, random.Random(f"{seed}-{n}"), startup)) for n in numbers]
            old = [(n, loss, params) for (n, params), loss in zip(drawn, run_all(lambda t: evaluate(*t), drawn))]
            finished(old)
        log += sorted(old, key=lambda t: t[0])
    return log


def _trial(estimator: QuantileEstimator, features: DataFrame, grain: Grain, k: int, horizon: int, number: int, params: dict) -> tuple:
    """One row of the trial log: the mean pinball loss at p50 over the walk-forward folds. Only p50 is fitted."""
    begun = datetime.now()
    one = estimator.copy({estimator.getParam(n): v for n, v in params.items()})
    if one.hasParam("quantiles"):
        one.set(one.getParam("quantiles"), ["p50"])
    # Trials run side by side already.
    row = walk_forward(one, features, grain, k, horizon, parallelism=1).agg(F.avg("Pinball_p50"), F.count("*")).first()
    if not row[1]:
        raise NoValidFoldError("no fold has enough training and test rows")
    done = datetime.now()
    return (number, row[0], begun, done, (done - begun).total_seconds(), *params.values(), "COMPLETE")


def _log(spark: SparkSession, rows: list[tuple], ranges: dict[str, tuple]) -> DataFrame:
    kinds = [T.LongType() if _whole(*r) else T.DoubleType() for r in ranges.values()]
    schema = T.StructType(
        [
            T.StructField("number", T.LongType()),
            T.StructField("value", T.DoubleType()),
            T.StructField("datetime_start", T.TimestampType()),
            T.StructField("datetime_complete", T.TimestampType()),
            T.StructField("duration", T.DoubleType()),
            *[T.StructField(f"params_{n}", kind) for n, kind in zip(ranges, kinds)],
            T.StructField("state", T.StringType()),
        ]
    )
    return spark.createDataFrame(rows, schema)


def random_search(
    estimator: QuantileEstimator,
    features: DataFrame,
    grain: Grain,
    ranges: dict[str, tuple],
    trials: int = 50,
    k: int = 4,
    horizon: int = 12,
    seed: int = 42,
    parallelism: int = 2,
) -> SearchResult:
    """Minimise the mean pinball loss at p50 over the walk-forward folds.

    Only p50 is fitted, as nothing else enters the loss. Raises :class:`NoValidFoldError` if no fold can be scored,
    instead of naming a best set that was never evaluated. One row per trial reaches the driver.
    """
    rng = random.Random(seed)
    drawn = [draw(ranges, rng) for _ in range(trials)]

    def run(numbered: tuple[int, dict]) -> tuple:
        return _trial(estimator, features, grain, k, horizon, *numbered)

    with ThreadPool(min(parallelism, trials)) as pool:
        rows = pool.map(inheritable_thread_target(features.sparkSession)(run), list(enumerate(drawn)))
    log = _log(features.sparkSession, rows, ranges)
    return SearchResult(log, best_params(log))


def guided_search(
    estimator: QuantileEstimator,
    features: DataFrame,
    grain: Grain,
    ranges: dict[str, tuple],
    trials: int = 50,
    k: int = 4,
    horizon: int = 12,
    seed: int = 42,
    parallelism: int = 2,
    startup: int = STARTUP,
    log_path: str | None = None,
) -> SearchResult:
    """Like :func:`random_search`, with draws guided by the batches before, ``parallelism`` trials a batch.

    With ``log_path`` every finished batch is written there, and a search over the same ranges and seed that finds it goes
    on from it. One row per trial reaches the driver.
    """
    spark, rows = features.sparkSession, {}
    if log_path and path_exists(spark, log_path):
        for r in spark.read.parquet(log_path).select(*_log(spark, [], ranges).columns).collect():
            rows[r.number] = tuple(r)
    known = [(n, row[1], dict(zip(ranges, row[5:-1]))) for n, row in rows.items()]

    def evaluate(number: int, params: dict) -> float:
        rows[number] = _trial(estimator, features, grain, k, horizon, number, params)
        return rows[number][1]

    def finished(batch: list[tuple]) -> None:
        if log_path:
            part = _log(spark, [rows[n] for n, _, _ in batch], ranges)
            part.coalesce(1).write.mode("overwrite").parquet(f"{log_path}/batch={batch[0][0]}")

    with ThreadPool(parallelism) as pool:
        done = guided_trials(
            evaluate, ranges, trials, seed, parallelism, startup, known, finished,
            lambda function, items: pool.map(inheritable_thread_target(spark)(function), items),
        )
    log = _log(spark, [rows[n] for n, _, _ in done], ranges)
    return SearchResult(log, best_params(log))


def best_params(trials: DataFrame) -> dict:
    """Parameters of the trial with the smallest loss; of equal ones the first."""
    names = [c for c in trials.columns if c.startswith("params_")]
    order = F.struct("value", "number")
    best = trials.agg(F.min_by(F.struct(*[F.col(c).alias(c.removeprefix("params_")) for c in names]), order)).first()[0]
    return best.asDict()


def fit_best(estimator: QuantileEstimator, features: DataFrame, best: dict):
    """Fit on all rows with the best parameters."""
    return estimator.copy({estimator.getParam(n): v for n, v in best.items()}).fit(features)
