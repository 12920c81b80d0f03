"""Session settings, and the shared folder that intermediate results go to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

# A table of at most this many rows and bytes may be broadcast.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20


def local_session(cpus: int | str = 8, app: str = "fanchart") -> SparkSession:
    """A single-machine session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the one ``spark.checkpoint.dir`` names, or a temporary one in local mode only."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="fanchart-shared-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark)}/fanchart/{uuid.uuid4().hex}"
    _file_system(spark, path).deleteOnExit(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    return _file_system(spark, path).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))


def drop_path(spark: SparkSession, path: str) -> None:
    _file_system(spark, path).delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)


def cut_lineage(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Write ``df`` (or only ``columns`` of it) to the shared folder and go on from there.

    Lost executors then cost no recomputation, and the scan of the written parquet keeps column pruning, filter pushdown
    and statistics. The files go when the application ends.
    """
    spark = df.sparkSession
    if columns is not None:
        df = df.select(*columns)
    path = scratch_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table that ``cut_lineage`` returned and that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/fanchart/" in folder:
            _file_system(spark, folder).delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder), True)


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """The narrow side of a join: written once, measured, and broadcast only if its rows and bytes are few.

    Without the count Spark would not know the size of an aggregate before shuffling the large side to meet it. Beyond
    the bounds the plain table is returned: a sort-merge join, whose skewed partitions Spark splits.
    """
    written = cut_lineage(df)
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if f.dataType.simpleString() == "string"]
    width = sum(texts, F.lit(16 * len(df.columns)))
    measured = written.agg(F.count("*").alias("n"), F.sum(width).alias("bytes")).first()
    return F.broadcast(written) if measured.n <= rows and (measured.bytes or 0) <= size else written
