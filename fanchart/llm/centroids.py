"""Exact k-means on integer vectors by Shallot search.

After Borgelt (2020). Every vector remembers its centroid, the second-nearest one it last knew, an upper bound on the
distance to the first and a lower bound on the distance to all others; the bounds follow the centroids' moves. A vector
whose upper bound lies below its lower bound, or below half the way to the nearest other centroid, needs no distance.
For the rest, the distances to the two remembered centroids say which is closer, and the other centroids are scanned in
order of their distance from that one, while they lie in a ball around it whose radius is the vector's distance to it plus
the distance to the second-nearest so far. The ball shrinks as nearer ones are found. Bounds are doubles with a margin and
only ever skip what is strictly farther; what is left is compared by exact squared distances in integers, and ties go to
the smaller number.

Vectors never move between tasks: a round is one pass that writes vectors and bounds to the shared folder, and the sums
of the clusters change by what the vectors that changed cluster add and take away. A round without a change ends the rounds, since all further
ones would be the same.

Kept are vectors with exactly ``dimensions`` components, none null or non-finite; components of 2^17 or more are refused,
so that squared distances fit into longs. Repeated rows are vectors of their own, null ids are never preferred as starts.
With fewer vectors than centroids there are as many centroids as vectors; equal starts leave the later ones empty, and an empty
centroid stays where it is. Columns besides id and vector are not read. No vector kept gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fanchart.llm.arrow import ship_package
from fanchart.session import cut_lineage, drop_written

SCALE = 1024
DIMENSIONS, CENTROIDS, ROUNDS = 64, 8, 10
LARGEST = float(1 << 17)
# Relative margin of the bounds; far above what their sums of a few doubles can be off.
MARGIN = 1e-9

STATE = "vec_id bigint, v array<int>, cluster int, second int, upper double, lower double, before int"


def on_grid(df: DataFrame, dimensions: int = DIMENSIONS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): the kept vectors in integers."""
    entries = F.transform(F.col(embedding), lambda c: c.cast("double"))
    usable = F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), entries.alias("c")).filter((F.size("c") == dimensions) & usable)
    refused = F.raise_error(F.lit("a component of a vector is too large")).cast("int")
    whole = F.transform("c", lambda c: F.when(F.abs(c) < LARGEST, F.floor(c * SCALE).cast("int")).otherwise(refused))
    return kept.select("vec_id", whole.alias("v"))


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, row by row."""
    off = vectors - centroids
    return np.einsum("ij,ij->i", off, off)


@dataclass
class Centroids:
    """The centroids of a round, how far each has moved, and each one's neighbours by distance."""

    points: np.ndarray
    moves: np.ndarray

    def __post_init__(self):
        k = len(self.points)
        gaps = np.sqrt([squared(self.points, p).astype(np.float64) for p in self.points]).reshape(k, k)
        self.gaps = gaps
        self.order = np.array([[j for j in np.argsort(row, kind="stable") if j != i] for i, row in enumerate(gaps)], dtype=np.int64)
        others = gaps + np.where(np.eye(k, dtype=bool), np.inf, 0)
        self.half = others.min(axis=1) / 2
        self.other_moves = np.array([np.delete(self.moves, i).max(initial=0.0) for i in range(k)])

    def assign(self, vectors: np.ndarray, cluster: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Bring the four arrays, changed in place, up to this round. Returns the number of distances computed."""
        upper += self.moves[cluster]
        lower -= self.other_moves[cluster]
        open_ = np.flatnonzero(~_below(upper, np.maximum(lower, self.half[cluster])))
        computed = len(open_)
        own = squared(vectors[open_], self.points[cluster[open_]])
        upper[open_] = np.sqrt(own)
        still = ~_below(upper[open_], np.maximum(lower[open_], self.half[cluster[open_]]))
        at, best, first = open_[still], own[still], cluster[open_[still]].astype(np.int64)
        if not len(at) or len(self.points) == 1:
            return computed
        next_ = second[at].astype(np.int64)
        runner = squared(vectors[at], self.points[next_])
        computed += len(at)
        swap = (runner < best) | ((runner == best) & (next_ < first))
        first[swap], next_[swap] = next_[swap], first[swap]
        best[swap], runner[swap] = runner[swap], best[swap]
        known = np.where(swap, first, next_), np.where(swap, next_, first)
        for start in np.unique(first).tolist():
            inside = np.flatnonzero(first == start)
            reach = np.sqrt(best[inside])
            for j in self.order[start].tolist():
                within = self.gaps[start, j] * (1 - MARGIN) <= (reach + np.sqrt(runner[inside])) * (1 + MARGIN)
                inside, reach = inside[within], reach[within]
                if not len(inside):
                    break
                todo = inside[(known[0][inside] != j) & (known[1][inside] != j)]
                found = squared(vectors[at[todo]], self.points[j])
                computed += len(todo)
                nearest = (found < best[todo]) | ((found == best[todo]) & (j < first[todo]))
                nearer = ~nearest & ((found < runner[todo]) | ((found == runner[todo]) & (j < next_[todo])))
                a, b = todo[nearest], todo[nearer]
                runner[a], next_[a] = best[a], first[a]
                best[a], first[a] = found[nearest], j
                runner[b], next_[b] = found[nearer], j
        cluster[at], second[at] = first, next_
        upper[at], lower[at] = np.sqrt(best), np.sqrt(runner)
        return computed


def _below(upper: np.ndarray, bound: np.ndarray) -> np.ndarray:
    return upper * (1 + MARGIN) < bound * (1 - MARGIN)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(-1, width)


def start_state(vectors: DataFrame) -> DataFrame:
    """Nothing known: both remembered centroids are the first two, and the bounds say nothing."""
    return vectors.select(
        "vec_id",
        "v",
        F.lit(0).alias("cluster"),
        F.lit(1).alias("second"),
        F.lit(float("inf")).alias("upper"),
        F.lit(0.0).alias("lower"),
        F.lit(-1).alias("before"),
    )


def assigned(state: DataFrame, centroids: Centroids, last: bool = False, first: bool = False) -> DataFrame:
    """The state after a round; after the ``last`` one (vec_id, cluster, distance)."""
    spark = state.sparkSession
    shared, width = spark.sparkContext.broadcast(centroids), centroids.points.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        for batch in batches:
            vectors = matrix(batch.column(1), width)
            cluster, second, upper, lower = (batch.column(i).to_numpy().copy() for i in range(2, 6))
            before = np.full_like(cluster, -1) if first else cluster.copy()
            now.assign(vectors, cluster, second, upper, lower)
            if last:
                distance = squared(vectors, now.points[cluster])
                made = [batch.column(0), pa.array(cluster), pa.array(distance)]
                yield pa.RecordBatch.from_arrays(made, names=["vec_id", "cluster", "distance"])
            else:
                made = [*batch.columns[:2], *map(pa.array, (cluster, second, upper, lower, before))]
                yield pa.RecordBatch.from_arrays(made, names=batch.schema.names)

    return state.mapInArrow(run, "vec_id bigint, cluster int, distance bigint" if last else STATE)


def changes(state: DataFrame, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """What the last round added to the clusters' counts and sums. A task sums up its vectors before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, dtype=np.int64), np.zeros((k, width), dtype=np.int64)
        for batch in batches:
            vectors, cluster, before = matrix(batch.column(0), width), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for i in range(k):
                come, gone = cluster == i, before == i
                counts[i] += come.sum() - gone.sum()
                sums[i] += vectors[come].sum(axis=0) - vectors[gone].sum(axis=0)
        made = [np.arange(k).repeat(width), np.tile(np.arange(width), k), counts.repeat(width), sums.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(m, pa.int64()) for m in made], names=["i", "at", "n", "s"])

    moved = state.filter("cluster <> before").select("v", "cluster", "before")
    parts = moved.mapInArrow(run, "i bigint, at bigint, n bigint, s bigint")
    counts, sums = np.zeros(k, dtype=np.int64), np.zeros((k, width), dtype=np.int64)
    for r in parts.groupBy("i", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        counts[r["i"]], sums[r["i"], r["at"]] = r["n"], r["s"]
    return counts, sums


def first_centroids(vectors: DataFrame, k: int = CENTROIDS) -> np.ndarray:
    """The vectors whose ids have the smallest hashes."""
    hashed = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return np.array([r.v for r in vectors.orderBy(hashed.asc_nulls_last(), "v").limit(k).collect()], dtype=np.int64)


def clusters(
    df: DataFrame,
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every kept vector."""
    spark = df.sparkSession
    ship_package(spark)
    state = cut_lineage(start_state(on_grid(df, dimensions, vec_id, embedding)))
    points = first_centroids(state, k)
    k = len(points)
    if not k:
        schema = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
        return spark.createDataFrame([], schema)
    if k == 1:
        # The second remembered centroid is not there.
        state = state.withColumn("second", F.lit(0))
    moves = np.zeros(k)
    counts, sums = np.zeros(k, dtype=np.int64), np.zeros((k, dimensions), dtype=np.int64)
    for round_ in range(rounds):
        after = cut_lineage(assigned(state, Centroids(points, moves), first=not round_))
        drop_written(state)
        state = after
        n, s = changes(state, k, dimensions)
        counts, sums = counts + n, sums + s
        moved = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], points)
        moves = np.sqrt(squared(moved, points))
        points = moved
        if not moves.any():
            break
    found = cut_lineage(assigned(state, Centroids(points, moves), last=True))
    drop_written(state)
    inertia = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, p.tolist())).encode()).hexdigest() for p in points]
    told = spark.createDataFrame(
        [(i, inertia.get(i, 0), sum(inertia.values()), digests[i]) for i in range(k)],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    )
    return found.join(F.broadcast(told), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
