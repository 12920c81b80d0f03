"""The record of a run's finished stages, so that a run started again does only what is left.

A stage has a version: a digest of its settings and of the version of what it reads. Its record, which holds the version,
is deleted before the stage begins and written after its last output, so a run that dies leaves no record of a stage it
did not finish. A stage counts as finished if its record holds the version that it would have now.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import SparkSession, functions as F

from fanchart.session import drop_path, path_exists


def input_version(spark: SparkSession, path: str) -> str:
    """Number, bytes and a digest of the names, sizes and times of the files of ``path``; no content is read."""
    files = spark.read.format("binaryFile").load(path)
    mark = F.xxhash64("path", "length", "modificationTime")
    found = files.agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), F.bit_xor(mark).alias("mark")).first()
    return f"{found.n}:{found.bytes}:{found.mark}"


def version_of(*parts) -> str:
    """Digest of settings and versions, which JSON can hold."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()


def _record(folder: str, stage: str) -> str:
    return f"{folder}/stages/{stage}"


def is_finished(spark: SparkSession, folder: str, stage: str, version: str) -> bool:
    path = _record(folder, stage)
    return path_exists(spark, path) and [r.value for r in spark.read.text(path).collect()] == [version]


def forget(spark: SparkSession, folder: str, stage: str) -> None:
    """Delete a stage's record, as something that it read was replaced."""
    drop_path(spark, _record(folder, stage))


def run_stage(spark: SparkSession, folder: str, stage: str, version: str | None, work: Callable[[], object]) -> bool:
    """Do ``work`` and record it, unless it is finished for ``version``; whether it was done.

    Without a version it is always done and not recorded, and an older record goes, as its outputs are replaced.
    """
    if version and is_finished(spark, folder, stage, version):
        return False
    forget(spark, folder, stage)
    work()
    if version:
        spark.createDataFrame([(version,)], "value string").coalesce(1).write.text(_record(folder, stage))
    return True
