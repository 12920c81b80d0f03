"""Arrow-batched row functions and sorted group streams: the two ways in which operators here run numpy inside tasks."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

# Rows turned into Python objects at a time.
SLICE_ROWS = 256

_ARROW = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()),
    "array<bigint>": pa.list_(pa.int64()),
    "array<double>": pa.list_(pa.float64()),
    "array<string>": pa.list_(pa.string()),
}


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this library to the Python workers, once per application, so that they need no installation of it."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[2]
        name = f"{tempfile.mkdtemp(prefix='fanchart-package-')}/fanchart"
        context.addPyFile(shutil.make_archive(name, "zip", root, "fanchart"))
        _SHIPPED.add(context.applicationId)


def map_rows(
    df: DataFrame, inputs: Sequence[str], outputs: dict[str, str], start: Callable[[], Callable], sliced: bool = False
) -> DataFrame:
    """``df`` with computed columns: ``start()`` runs once per task and returns a function of one row's ``inputs``.

    The function returns a tuple in the order of ``outputs`` (name to Spark type); if ``sliced``, it gets lists with
    the values of some rows and returns their tuples. A column of ``df`` that has the name of an output is replaced.
    """
    ship_package(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name not in outputs]
    names = [f.name for f in kept]
    read = [*names, *(c for c in inputs if c not in names)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"`{c}` {t}" for c, t in outputs.items())])
    kinds = [_ARROW[t] for t in outputs.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = start()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                columns = [batch.column(read.index(c)).to_pylist() for c in inputs]
                rows = function(*columns) if sliced else [function(*row) for row in zip(*columns)]
                made = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in range(len(names))), *made], names=[*names, *outputs]
                )

    return df.select(*(F.col(f"`{c}`") for c in read)).mapInArrow(run, schema)


def map_groups(df: DataFrame, key: str, order: Sequence[str], schema: str, start: Callable[[], Callable]) -> DataFrame:
    """Stream the groups of the long column ``key``: ``start()`` gives a function of a table of whole groups.

    Rows are dealt by ``key`` and sorted, and each call gets one or more whole groups (``pa.Table``), sorted by ``key``
    and ``order``, of an Arrow batch's size or one group, whichever is larger. Callers bound their groups. The function
    yields record batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function, held = start(), []
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.schema.names.index(key)
            keys = batch.column(at).to_numpy(zero_copy_only=False)
            # The last group may go on in the next batch.
            cut = int(np.searchsorted(keys, keys[-1], side="left"))
            if held and held[-1].column(at)[0].as_py() == keys[0] and not cut:
                held.append(batch)
                continue
            if held or cut:
                yield from function(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = [batch.slice(cut)]
        if held:
            yield from function(pa.Table.from_batches(held))

    ship_package(df.sparkSession)
    return df.repartition(F.col(key)).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def bounds(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the length as last entry."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else np.array([0])
