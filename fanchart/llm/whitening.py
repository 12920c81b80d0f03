"""Whitening of embeddings on Spark MLlib's block matrices.

Entries are put on an integer grid, x = floor(1024 * c) + 100000, so that sums are exact. The centred rows x - S/n are
numbered and become a distributed block matrix X. X' X, divided by n, is the covariance; its eigenvectors, found on the
driver, make the whitening matrix W (columns: unit eigenvector over the root of its eigenvalue), and X W, another product
of block matrices, projects all rows. Only matrices of the vectors' width, never rows, reach the driver. The inner
dimension of X' X is the number of rows: it is multiplied in splits of ``SPLIT`` row blocks, whose small products are
added up, so that no task meets all blocks.

A row with a null vector, or one that holds null or non-finite entries, is dropped. Vectors shorter than the longest are
filled up with c = 0, empty ones too. Repeated rows and null ids are rows of their own, each with all components. There are
``COMPONENTS`` components at most, and at most as many as dimensions. A component whose eigenvalue is zero up to rounding
has a null ``whitened`` and is left out of ``identity_error``; if the trace is zero, ``explained`` is null. A
``deviation`` that does not fit into a long is null. Entries from 2^42 on are refused, as sums of them would not be exact.
Columns besides id and vector are not read. An empty table, or one with no row left, gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, functions as F

from fanchart.session import cut_lineage

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
# Rows and columns of a block, and row blocks that one task of X' X multiplies.
ROWS, COLUMNS, SPLIT = 1024, 1024, 32
LARGEST = float(1 << 42)


def on_grid(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, x) for the rows that remain."""
    entries = F.transform(F.col(embedding), lambda c: c.cast("double"))
    usable = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = df.select(F.col(vec_id).alias("vec_id"), entries.alias("c")).filter(F.col("c").isNotNull() & usable)
    refused = F.raise_error(F.lit("an entry of a vector is too large")).cast("bigint")
    x = F.transform("c", lambda c: F.when(F.abs(c) < LARGEST, F.floor(c * SCALE).cast("bigint") + SHIFT).otherwise(refused))
    return kept.select("vec_id", x.alias("x"))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``index``, from 0 without gaps, in the order they were written. One count per partition is broadcast."""
    placed = rows.withColumn("_id", F.monotonically_increasing_id())
    placed = cut_lineage(placed.withColumn("_part", F.shiftright("_id", 33)))
    counts = sorted((r._part, r["count"]) for r in placed.groupBy("_part").count().collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    starts = rows.sparkSession.createDataFrame(starts, "_part bigint, _start bigint")
    within = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(starts), "_part").select(*rows.columns, (F.col("_start") + within).alias("index"))


def sums_of(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows of ``x`` and the exact sum of every entry; a shorter vector's missing entries count as c = 0."""
    entries = rows.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("s"), F.count("v").alias("n"))
    n = rows.count()
    return n, [r.s + SHIFT * (n - r.n) for r in sorted(entries.collect())]


def multiply(a: BlockMatrix, b: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """Product with the inner dimension cut into ``splits`` parts, an argument of MLlib that its Python method lacks."""
    product = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, a.rowsPerBlock, b.colsPerBlock)


def eigen(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues falling, and unit eigenvectors as columns."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    return values[::-1], vectors[:, ::-1]


def whitened_rows(df: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row per remaining row and component."""
    spark = df.sparkSession
    rows = numbered(on_grid(df, vec_id, embedding))
    n, sums = sums_of(rows)
    size = len(sums)
    if not n or not size:
        empty = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
        return spark.createDataFrame([], empty)
    total, count = F.lit(sums), F.lit(n).cast("bigint")
    filled = F.when(F.size("x") < size, F.concat("x", F.array_repeat(F.lit(SHIFT).cast("bigint"), F.lit(size) - F.size("x")))).otherwise(F.col("x"))
    # n x - S is an exact integer, so that centring rounds once.
    off = F.zip_with(filled, total, lambda x, s: count * x - s)
    squares = F.aggregate("off", F.lit(0).cast("bigint"), lambda sum_, o: F.try_add(sum_, F.try_multiply(o, o)))
    rows = rows.select("index", "vec_id", off.alias("off"))
    told = rows.select("index", "vec_id", squares.alias("deviation"))
    centred = rows.select("index", array_to_vector(F.transform("off", lambda o: o / count)).alias("row"))
    centred = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(centred, "row"), n, size)
    x = centred.toBlockMatrix(ROWS, min(size, COLUMNS))
    scatter = multiply(x.transpose(), x, math.ceil(n / ROWS / SPLIT)).toLocalMatrix().toArray()
    values, vectors = eigen(scatter / n)
    used = min(components, size)
    trace, values, vectors = float(np.trace(scatter)) / n, values[:used], vectors[:, :used]
    real = values > max(values[0], 0) * size * np.finfo(float).eps
    whitening = np.where(real, vectors / np.sqrt(np.where(real, values, 1.0)), 0.0)
    blocks = [
        ((at // x.colsPerBlock, 0), Matrices.dense(*part.shape, part.ravel(order="F").tolist()))
        for at in range(0, size, x.colsPerBlock)
        for part in [whitening[at : at + x.colsPerBlock]]
    ]
    w = BlockMatrix(spark.sparkContext.parallelize(blocks), x.colsPerBlock, used, size, used)
    projected = multiply(x, w).toIndexedRowMatrix()
    z = callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model)
    z = MLUtils.convertVectorColumnsToML(z, "vector").select("index", vector_to_array("vector").alias("z"))
    written = cut_lineage(told.join(z, "index").drop("index"))
    at = [(i, j) for i in range(used) for j in range(i + 1) if real[i] and real[j]]
    covariances = [F.covar_pop(F.get("z", F.lit(i)), F.get("z", F.lit(j))).alias(f"c{i}_{j}") for i, j in at]
    found = written.agg(*covariances).first() if at else []
    error = max((abs(c - (i == j)) for c, (i, j) in zip(found, at)), default=None)
    shares = F.lit([float(v) / trace if trace > 0 else None for v in values])
    each = F.posexplode("z").alias("at", "value")
    return written.select("vec_id", "deviation", each).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        count.alias("n"),
        "deviation",
        F.when(F.get(F.lit([bool(r) for r in real]), F.col("at")), F.col("value")).alias("whitened"),
        F.get(shares, F.col("at")).cast("double").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
