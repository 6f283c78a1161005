"""Predicates and semi joins that cut the log down."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixeltide.functions.time import Moment, as_moment, as_range, in_frame, in_frame_once, last_inside, moment
from pixeltide.sources.schema import DAY, FOLDER_MARK, HOUR, PARSED_MARK

FOLDER_FORMATS = {HOUR: "%Y%m%d%H", DAY: "%Y%m%d"}


def within_frame(log: DataFrame, start: Moment, end: Moment, end_inclusive: bool = False) -> DataFrame:
    """The placements of a frame, read from its own folders only if ``read_log`` found them."""
    first, last = as_range(start, end)
    last = last_inside(last, end_inclusive)
    parsed = PARSED_MARK in log.schema["timestamp"].metadata
    inside = in_frame_once if parsed else in_frame
    rows = log.filter(inside("timestamp", start, end, end_inclusive))
    for column in _folders(log):
        rows = rows.filter(F.col(column).between(_number(column, first), _number(column, last)))
    return rows


def until(log: DataFrame, end: Moment, end_inclusive: bool = True) -> DataFrame:
    """The placements up to a moment, whatever their start."""
    last = last_inside(as_moment(end), end_inclusive)
    rows = log.filter(F.col("timestamp") <= moment(last))
    for column in _folders(log):
        rows = rows.filter(F.col(column) <= _number(column, last))
    return rows


def _folders(log: DataFrame) -> list[str]:
    made_from_it = log.schema["timestamp"].metadata.get(FOLDER_MARK)
    return [
        column
        for column in FOLDER_FORMATS
        if column == made_from_it and column in log.columns and log.schema[column].metadata.get(FOLDER_MARK) == column
    ]


def _number(column: str, at: datetime) -> int:
    return int(at.strftime(FOLDER_FORMATS[column]))


def in_box(cx: int, cy: int, radius: int) -> Column:
    """True within ``radius`` of the centre on both axes, as plain ranges that push down."""
    return F.col("x").between(cx - radius, cx + radius) & F.col("y").between(cy - radius, cy + radius)


def pixels_table(spark: SparkSession, pixels: Sequence[tuple[int, int]]) -> DataFrame:
    """Typed-in cells as an in-plan table ``(x, y)``."""
    rows = ", ".join(f"({int(x)}, {int(y)})" for x, y in pixels)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS pixels(x, y)")


def at_pixels(log: DataFrame, pixels: DataFrame | Sequence[tuple[int, int]]) -> DataFrame:
    """The placements on the given cells.

    ``pixels`` is a list of ``(x, y)`` or a DataFrame with ``x`` and ``y``, such
    as ``top_pixels(..)``. No broadcast hint: Spark sees the exact size of a
    list and of a LIMIT, broadcasts if that is below its threshold, and sorts
    and merges otherwise. A list also bounds the scan.
    """
    if isinstance(pixels, DataFrame):
        return log.join(pixels.select("x", "y"), ["x", "y"], "left_semi")
    if not pixels:
        raise ValueError("no pixels given")
    xs, ys = zip(*pixels)
    bounded = log.filter(F.col("x").between(min(xs), max(xs)) & F.col("y").between(min(ys), max(ys)))
    return bounded.join(pixels_table(log.sparkSession, pixels), ["x", "y"], "left_semi")
