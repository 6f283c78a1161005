"""Raw CSV log to clean log."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixeltide.functions.coordinate import split_coordinate
from pixeltide.functions.time import parse_timestamp
from pixeltide.sources.schema import CLEAN, PARSED_MARK, RAW
from pixeltide.sources.shared_folder import stored

#: Column for the text of a line that does not split into the columns of its header.
BROKEN = "broken_line"


def read_raw_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The raw log by column name, all columns text.

    Names come from the header line (no inference pass over the data), so the
    column order of the file does not matter. ``enforceSchema`` is off: a file
    of the folder with another header fails instead of being read wrongly.
    Plain and bzip2 files are split among tasks; a gzip file is one task.
    """
    rows = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    return rows.select(*RAW.fieldNames())


def timed_raw_log(raw: DataFrame, strict_timestamps: bool = False) -> DataFrame:
    """The raw log with parsed timestamps and the coordinates still text.

    For frame questions straight from CSV: a four-part coordinate stays a key
    of its own here, while ``clean_log`` cuts it to its first two parts.
    """
    parsed = parse_timestamp("timestamp", strict_timestamps)
    return raw.withColumn("timestamp", parsed.alias("timestamp", metadata={PARSED_MARK: True}))


def clean_log(
    raw: DataFrame,
    strict_timestamps: bool = False,
    strict_coordinates: bool = True,
) -> DataFrame:
    """Parsed timestamp, 64-bit user key and int coordinates in one projection."""
    return raw.select(
        parse_timestamp("timestamp", strict_timestamps).alias("timestamp"),
        F.xxhash64("user_id").alias("user_id_hashed"),
        "pixel_color",
        *split_coordinate("coordinate", strict_coordinates),
    )


def ingest_csv(
    spark: SparkSession,
    path: str | list[str],
    strict_timestamps: bool = False,
    strict_coordinates: bool = True,
) -> DataFrame:
    """The clean log of a raw CSV file or folder; see ``write_log`` to keep it."""
    return clean_log(read_raw_csv(spark, path), strict_timestamps, strict_coordinates)


def checked_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every line of a raw CSV log as a clean row plus ``reason``, ``file`` and ``line``.

    ``reason`` is NULL for a good row, else the first of: ``columns`` (an unclosed
    quote, missing or extra columns), ``timestamp`` (missing or no UTC time),
    ``coordinate`` (missing or no number in one of the first two parts). ``file`` is the
    path of the file, ``line`` its line. A NULL user or colour is no fault.
    Empty lines and header lines are no rows. All files have the columns of
    the first; a header with the same names in another order is an error, as rows
    would be read wrongly.
    """
    names = spark.read.option("header", True).csv(path).columns
    lost = [name for name in RAW.fieldNames() if name not in names]
    if lost:
        raise ValueError(f"no raw log at {path}: columns {', '.join(lost)} are missing")
    schema = T.StructType([T.StructField(name, T.StringType()) for name in [*names, BROKEN]])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where("trim(value) <> ''")
    fields = lines.withColumn("_row", F.from_csv("value", schema.simpleString()[len("struct<") : -1].replace(":", " "), options))
    found = F.array(*(F.col("_row").getField(name) for name in names))
    header, other = F.array(*map(F.lit, names)), F.array(*map(F.lit, sorted(names)))
    # A header in another order stops the job; the error is made only there.
    kept = F.when(found == header, False).when(
        F.array_sort(found) == other, F.raise_error(F.concat(F.lit("other order of columns: "), "value")).cast("boolean")
    )
    rows = fields.where(F.coalesce(kept, F.lit(True))).select("file", F.col("value").alias("line"), "_row.*")
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    x, y = split_coordinate("coordinate", strict=False)
    moment = parse_timestamp("timestamp")
    reason = (
        F.when(F.col(BROKEN).isNotNull() | (quotes % 2 == 1), "columns")
        .when(moment.isNull(), "timestamp")
        .when(x.isNull() | y.isNull(), "coordinate")
    )
    return rows.select(
        moment.alias("timestamp"),
        F.xxhash64("user_id").alias("user_id_hashed"),
        "pixel_color",
        x,
        y,
        reason.alias("reason"),
        "file",
        "line",
    )


class Ingested(NamedTuple):
    """Good rows as a clean log, and the others as (file, reason, line)."""

    accepted: DataFrame
    rejected: DataFrame


def ingest_checked(spark: SparkSession, path: str | list[str]) -> Ingested:
    """The clean log of a raw CSV log, and the lines it cannot hold; see ``checked_csv`` for the rules.

    The files are read once: checked rows are written to the shared folder, and
    both results read them from there, so that every line is in exactly one.
    """
    checked = checked_csv(spark, path)
    rows = stored(checked.withColumn("line", F.when(F.col("reason").isNotNull(), F.col("line"))), "checked-log")
    return Ingested(
        rows.where("reason is null").select(*CLEAN.fieldNames()),
        rows.where("reason is not null").select("file", "reason", "line"),
    )
