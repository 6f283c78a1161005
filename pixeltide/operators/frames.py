"""Most placed colour and cell in one or several time frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixeltide.functions.coordinate import coordinate_text
from pixeltide.functions.time import Frame, Moment, hour_frames, in_frame, moment
from pixeltide.operators.filters import within_frame


def mode_in_frame(
    log: DataFrame,
    key: str,
    start: Moment,
    end: Moment,
    end_inclusive: bool = False,
) -> DataFrame:
    """The most frequent non-NULL ``key`` of the frame and its count.

    One row, or none if the frame is empty. The smallest key wins a tie.
    """
    return (
        within_frame(log, start, end, end_inclusive)
        .filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count("*").alias("placements"))
        .orderBy(F.desc("placements"), key)
        .limit(1)
    )


def mode_coordinate_in_frame(
    log: DataFrame,
    start: Moment,
    end: Moment,
    end_inclusive: bool = False,
) -> DataFrame:
    """The most painted cell of the frame as text ``x,y``, and its count.

    Groups on the two ints and only then makes the text that decides ties.
    """
    group_by, cell = _cell(log)
    return (
        within_frame(log, start, end, end_inclusive)
        .filter(cell.isNotNull())
        .groupBy(*group_by)
        .agg(F.count("*").alias("placements"))
        .select(cell.alias("coordinate"), "placements")
        .orderBy(F.desc("placements"), "coordinate")
        .limit(1)
    )


def _within_any(log: DataFrame, frames: Sequence[Frame], end_inclusive: bool) -> DataFrame:
    first = min(frame.start for frame in frames)
    last = max(frame.end for frame in frames)
    return within_frame(log, first, last, end_inclusive)


def _frame_counts(frames: Sequence[Frame], end_inclusive: bool) -> list[Column]:
    """One conditional count per frame: every frame is answered by the same scan."""
    return [
        F.count_if(in_frame("timestamp", frame.start, frame.end, end_inclusive)).alias(f"n{i}")
        for i, frame in enumerate(frames)
    ]


def _cell(log: DataFrame) -> tuple[list[str], Column]:
    """What to group cells by, and their text form."""
    if "coordinate" in log.columns:
        return ["coordinate"], F.col("coordinate")
    return ["x", "y"], coordinate_text()


def _top(key: Column, n: str, of: Column | None = None) -> Column:
    """Over all tallies: the key with the largest ``n``, the smallest key on a tie.

    The least ``(-n, key)``, so each task passes on a single candidate.
    """
    eligible = key.isNotNull() & (F.col(n) > 0)
    if of is not None:
        eligible &= of
    return F.min(F.when(eligible, F.struct((-F.col(n)).alias("minus_n"), key.alias("key"))))


def _frame_columns(frame: Frame) -> list[Column]:
    hours = (frame.end - frame.start).total_seconds() / 3600
    return [
        F.lit(frame.name).alias("name"),
        F.lit(int(hours)).alias("hours"),
        moment(frame.start).alias("frame_start"),
        moment(frame.end).alias("frame_end"),
    ]


def timeframe_modes(
    log: DataFrame,
    key: str,
    start: Moment,
    hours: Sequence[int] = (1, 3, 6),
    end_inclusive: bool = False,
) -> DataFrame:
    """``mode_in_frame`` for several frames from one scan, one row per frame.

    ``key`` is a column, or ``"coordinate"`` for the cells of a clean log.
    An empty frame has a NULL key.
    """
    frames = hour_frames(start, tuple(hours))
    group_by, value = _cell(log) if key == "coordinate" else ([key], F.col(key))
    tallies = (
        _within_any(log, frames, end_inclusive)
        .groupBy(*group_by)
        .agg(*_frame_counts(frames, end_inclusive))
    )
    tops = tallies.agg(*[_top(value, f"n{i}").alias(f"top{i}") for i in range(len(frames))])
    rows = [
        F.struct(
            *_frame_columns(frame),
            F.col(f"top{i}.key").alias(key),
            (-F.col(f"top{i}.minus_n")).alias("placements"),
        )
        for i, frame in enumerate(frames)
    ]
    return tops.select(F.inline(F.array(*rows)))


def timeframe_summary(
    log: DataFrame,
    start: Moment,
    hours: Sequence[int] = (1, 3, 6),
    end_inclusive: bool = False,
) -> DataFrame:
    """One row per frame with its most placed colour and its most painted cell.

    The cell is the text ``coordinate`` if the log has that column, else x and y.

    The colour and the cell counts of all frames are grouping sets of one scan
    and one shuffle. Rows are combined before the shuffle.
    """
    frames = hour_frames(start, tuple(hours))
    cell_key, cell = _cell(log)
    tallies = (
        _within_any(log, frames, end_inclusive)
        .groupingSets([["pixel_color"], cell_key], "pixel_color", *cell_key)
        .agg(F.grouping("pixel_color").alias("by_cell"), *_frame_counts(frames, end_inclusive))
    )
    by_color = F.col("by_cell") == 0
    color = F.col("pixel_color")
    tops = tallies.agg(
        *[_top(color, f"n{i}", by_color).alias(f"color{i}") for i in range(len(frames))],
        *[_top(cell, f"n{i}", ~by_color).alias(f"cell{i}") for i in range(len(frames))],
    )
    rows = [
        F.struct(
            *_frame_columns(frame),
            F.lit(f"{frame.start} to {frame.end}").alias("timeframe"),
            F.col(f"color{i}.key").alias("most_color"),
            (-F.col(f"color{i}.minus_n")).alias("color_placements"),
            F.col(f"cell{i}.key").alias("most_pixel"),
            (-F.col(f"cell{i}.minus_n")).alias("pixel_placements"),
        )
        for i, frame in enumerate(frames)
    ]
    return tops.select(F.inline(F.array(*rows)))
