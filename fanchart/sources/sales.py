"""Reading and writing panels, promotion plans and forecasts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from fanchart.functions.dates import ISO_FORMATS, parse_date
from fanchart.functions.text import normalise_sku
from fanchart.grain import DAILY, Grain
from fanchart.operators.panel import monthly_rollup, normalise, period
from fanchart.schema import FORECAST_TYPES, PANEL_DEFAULTS, PANEL_TYPES, PLAN_TYPES, require_columns

# Quoted fields may hold commas and doubled quotes.
CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}


# Settings of the header scan: no file is cut or packed with others, so that a task has one file and reads a few lines.
HEADER_SCAN = {
    "spark.sql.files.maxPartitionBytes": str(1 << 40),
    "spark.sql.files.openCostInBytes": str(1 << 40),
    "spark.sql.execution.arrow.maxRecordsPerBatch": "16",
}
NUMBERS = (T.DoubleType, T.IntegerType, T.LongType)


class BadValuesError(ValueError):
    """A file has dates or numbers that cannot be read."""


def _files_by_header(spark: SparkSession, path: str) -> list[list[str]]:
    """The files of ``path``, one list per distinct header line; a single list without names if there is but one file.

    One job, in a session of its own settings: a task gets one file and stops at its first line that is not blank. Files
    without such a line have no rows and are left out, unless all are like that.
    """
    apart = spark.newSession()
    for name, value in HEADER_SCAN.items():
        apart.conf.set(name, value)
    lines = apart.read.text(path)
    if len(lines.inputFiles()) < 2:
        return [[]]

    def first_line(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and batch.column(0)[0].as_py():
                # Not the start of its file.
                return
            for i, line in enumerate(batch.column(2).to_pylist()):
                if line.strip():
                    yield batch.slice(i, 1)
                    return

    # The path is given as a URI, in which a plus sign stands for itself.
    file = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    place = [F.col("_metadata.file_block_start").alias("start"), file.alias("file")]
    found = lines.select(*place, "value").mapInArrow(first_line, "start bigint, file string, value string")
    # The driver gets what the listing of the folder holds too: the names of the files.
    groups = found.groupBy("value").agg(F.sort_array(F.collect_list("file")).alias("files")).collect()
    return sorted(r.files for r in groups) or [[]]


def _raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, with ``line``, the place of a row: file, offset of its block, number within the block.

    Files of a folder may have their columns in different orders or lack some. Each distinct header is read apart and
    the parts are united by name; a file whose header is not the one it was read with stops the read. A column that a
    file lacks and others have gets the panel's default in its rows, as it would if all files lacked it.
    """
    reader = spark.read.options(**CSV_OPTIONS).option("inferSchema", False).option("enforceSchema", False)
    by_line = _files_by_header(spark, path)
    by_header: dict[tuple[str, ...], list[str]] = {}
    for own in by_line:
        # The reader itself turns a header into names, one small job per distinct header.
        names = tuple(reader.csv(path if len(by_line) == 1 else own[0]).columns)
        by_header.setdefault(names, []).extend(own)
    parts = []
    for names, own in by_header.items():
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        source = path if len(by_header) == 1 else own
        place = F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        )
        parts.append(reader.schema(schema).csv(source).select(*names, place.alias("line")))
    everywhere = {name for names in by_header for name in names}
    for i, part in enumerate(parts):
        absent = [c for c in PANEL_DEFAULTS if c in everywhere and c not in part.columns]
        parts[i] = part.withColumns({c: F.lit(str(PANEL_DEFAULTS[c])) for c in absent}) if absent else part
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def _read_csv(spark: SparkSession, path: str, types: dict[str, T.DataType], line: bool = False) -> DataFrame:
    """Read a CSV whose columns come in any order, every SKU as text and every date as text.

    The header decides which columns exist; no pass over the data infers types. Known columns are cast afterwards.
    """
    typed = _typed(_raw_csv(spark, path), types)
    return typed if line else typed.drop("line")


def _typed(raw: DataFrame, types: dict[str, T.DataType]) -> DataFrame:
    """Known columns cast, but dates, which stay text."""
    casts = {
        name: F.col(name).try_cast(kind)
        for name, kind in types.items()
        if name in raw.columns and name != "date" and not isinstance(kind, T.StringType)
    }
    return raw.withColumns(casts) if casts else raw


def count_bad_values(
    spark: SparkSession, path: str, types: dict[str, T.DataType], formats: tuple[str, ...] = ISO_FORMATS
) -> dict[str, int]:
    """Per column of ``types`` the number of texts that are not empty and cannot be read; columns without any are left
    out. One pass over the columns in question."""
    return _bad_values(_raw_csv(spark, path), types, formats)


def _bad_values(raw: DataFrame, types: dict[str, T.DataType], formats: tuple[str, ...]) -> dict[str, int]:
    checks = {"date": parse_date(F.col("date"), formats)} if "date" in raw.columns else {}
    checks |= {n: F.col(n).try_cast(k) for n, k in types.items() if n in raw.columns and isinstance(k, NUMBERS)}
    bad = [F.count_if((F.trim(n) != "") & value.isNull()).alias(n) for n, value in checks.items()]
    found = raw.agg(*bad).first().asDict() if bad else {}
    return {name: count for name, count in found.items() if count}


def read_sales(spark: SparkSession, path: str, grain: Grain, formats: tuple[str, ...] = ISO_FORMATS) -> DataFrame:
    """A sales CSV as a normalised panel."""
    return normalise(_read_csv(spark, path, PANEL_TYPES), grain, formats)


def read_raw_sales(spark: SparkSession, path: str) -> DataFrame:
    """A sales CSV as it is: dates and SKUs as text, numbers cast, no defaults."""
    return _read_csv(spark, path, PANEL_TYPES)


def read_promo_plan(
    spark: SparkSession, path: str, grain: Grain, formats: tuple[str, ...] = ISO_FORMATS
) -> DataFrame:
    """A promotion plan CSV as (date, sku, category, promo_flag, line).

    ``line`` keeps the file order, which decides between two rows for one (date, sku).
    """
    plan = _read_csv(spark, path, PLAN_TYPES, line=True)
    require_columns(plan, ["date", "sku", "promo_flag"], "promo plan")
    if "category" not in plan.columns:
        plan = plan.withColumn("category", F.lit(PANEL_DEFAULTS["category"]))
    plan = plan.withColumns({"date": period(plan, grain, formats), "sku": normalise_sku(F.col("sku"))})
    return plan.select(*PLAN_TYPES, "line")


def write_panel(panel: DataFrame, path: str) -> None:
    """A panel as parquet, partitioned by year so that a lookback reads only the years it needs."""
    by_year = panel.withColumn("year", F.year("date"))
    by_year.write.mode("overwrite").partitionBy("year").parquet(path)


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """A panel written by :func:`write_panel`."""
    return spark.read.parquet(path).drop("year")


def write_normalised(
    spark: SparkSession,
    source: str,
    target: str,
    grain: Grain,
    formats: tuple[str, ...] = ISO_FORMATS,
    roll_up: bool = False,
) -> DataFrame:
    """Normalise a sales CSV into a new panel and read that back; the source is never overwritten.

    ``roll_up`` takes daily rows and sums them to months. Raises :class:`BadValuesError` with the counts if dates or
    numbers cannot be read, instead of dropping rows.
    """
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("target must differ from source: Spark cannot overwrite what it reads")
    # Headers are read once, for the check and for the panel.
    raw = _raw_csv(spark, source)
    if bad := _bad_values(raw, PANEL_TYPES, formats):
        raise BadValuesError(f"{source} has values that cannot be read, by column: {bad}; date formats are {formats}")
    panel = normalise(_typed(raw, PANEL_TYPES).drop("line"), DAILY if roll_up else grain, formats)
    if roll_up:
        panel = normalise(monthly_rollup(panel), grain)
    write_panel(panel, target)
    return read_panel(spark, target)


def write_csv(table: DataFrame, path: str) -> None:
    """A table as CSV, one file per partition."""
    table.write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)


def write_forecast(forecast: DataFrame, path: str) -> None:
    """A forecast as CSV, sorted by SKU and date within each file."""
    table = forecast.select(*[c for c in ["scenario", *FORECAST_TYPES] if c in forecast.columns])
    write_csv(table.repartitionByRange("sku", "date").sortWithinPartitions("sku", "date"), path)


def read_forecast(spark: SparkSession, path: str) -> DataFrame:
    """A forecast written by :func:`write_forecast`; raises FileNotFoundError if there is none."""
    try:
        table = _read_csv(spark, path, FORECAST_TYPES)
    except AnalysisException as e:
        raise FileNotFoundError(f"no forecast at {path}") from e
    table = table.withColumn("date", F.to_date("date"))
    if "sku" not in table.columns:
        return table.withColumn("sku", F.lit(PANEL_DEFAULTS["sku"]))
    return table.withColumn("sku", normalise_sku(F.col("sku")))
