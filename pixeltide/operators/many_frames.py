"""Most placed colour and cell of any number of time frames, by an interval join.

The borders of all frames cut time into elementary intervals. Every placement
lies in one of them, found by an equi-join on the hour (an interval is listed
under each hour it touches), so no frame is ever compared with every placement.
Placements are counted once per key and interval, combined before the shuffle,
and a frame's counts are the sums over the intervals it covers, by an equi-join
on the interval's number. The plan is the same for three frames and for
thousands; overlapping frames share the counts of what they have in common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixeltide.functions.time import Moment, as_range, moment
from pixeltide.operators.frames import _cell


def sliding_frames(spark: SparkSession, start: Moment, end: Moment, hours: int, every_hours: int = 1) -> DataFrame:
    """(frame_start, frame_end) of frames of ``hours`` that begin every ``every_hours`` from ``start`` until before ``end``."""
    first, last = as_range(start, end)
    if hours <= 0 or every_hours <= 0:
        raise ValueError(f"hours must be positive: {hours}, {every_hours}")
    many = -(-int((last - first).total_seconds()) // (3600 * every_hours))
    begin = moment(first) + F.make_dt_interval(hours=(F.col("id") * every_hours).cast("int"))
    return spark.range(many).select(begin.alias("frame_start"), (begin + F.make_dt_interval(hours=F.lit(hours))).alias("frame_end"))


def _slot(ts: Column) -> Column:
    """Number of the hour a zone-less time lies in: from days and hours, so no time zone is involved."""
    return F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour(ts)


def elementary_intervals(frames: DataFrame) -> DataFrame:
    """(number, begins, ends) of the stretches of time between neighbouring borders of ``frames(frame_start, frame_end)``.

    Borders are ordered in one task: a frame has two of them, however long the log is.
    """
    borders = frames.select(F.col("frame_start").alias("begins")).union(frames.select("frame_end")).distinct()
    by_time = Window.orderBy("begins")
    return borders.where("begins is not null").select(
        F.row_number().over(by_time).cast("long").alias("number"), "begins", F.lead("begins").over(by_time).alias("ends")
    )


def _counts(log: DataFrame, keys: list[str], intervals: DataFrame) -> DataFrame:
    """(number, keys, n): placements of every key in every elementary interval."""
    whole = intervals.where("ends is not null")
    last = F.col("ends") - F.make_dt_interval(secs=F.lit(0.000001).cast("decimal(18,6)"))
    listed = whole.withColumn("slot", F.explode(F.sequence(_slot(F.col("begins")), _slot(last))))
    found = log.withColumn("slot", _slot(F.col("timestamp"))).join(listed, "slot")
    return found.where("timestamp >= begins and timestamp < ends").groupBy("number", *keys).agg(F.count("*").alias("n"))


def frame_modes(log: DataFrame, frames: DataFrame, key: str) -> DataFrame:
    """``frames`` plus ``key`` and ``placements``: the most frequent ``key`` of every frame.

    ``frames`` has frame_start and frame_end (exclusive) and any other columns,
    which are kept; frames may overlap, lie apart or be equal. ``key`` is a
    column, or ``"coordinate"`` for the cells of a clean log. NULL keys cannot
    win; the smallest key wins a tie; a frame without placements, one that does
    not end after its start or that lacks a border has a NULL key. Placements
    without time are in no frame.
    """
    keys, value = _cell(log) if key == "coordinate" else ([key], F.col(key))
    frames = frames.select(F.struct(*frames.columns).alias("frame"), "frame_start", "frame_end")
    spans = frames.where("frame_start < frame_end").select("frame_start", "frame_end").distinct()
    intervals = elementary_intervals(spans)
    counts = _counts(log.where(value.isNotNull()), keys, intervals)
    at = lambda name, border: intervals.select(F.col("begins").alias(border), F.col("number").alias(name))
    covers = spans.join(at("first", "frame_start"), "frame_start").join(at("beyond", "frame_end"), "frame_end")
    covers = covers.select("frame_start", "frame_end", F.explode(F.sequence("first", F.col("beyond") - 1)).alias("number"))
    totals = counts.join(covers, "number").groupBy("frame_start", "frame_end", *keys).agg(F.sum("n").alias("n"))
    # The least (-n, key): each task passes on one candidate a frame.
    best = F.min(F.struct((-F.col("n")).alias("minus_n"), value.alias("key")))
    tops = totals.groupBy("frame_start", "frame_end").agg(best.alias("top"))
    tops = tops.select("frame_start", "frame_end", F.col("top.key").alias("_key"), (-F.col("top.minus_n")).alias("_n"))
    return frames.join(tops, ["frame_start", "frame_end"], "left").select(
        "frame.*", F.col("_key").alias(key), F.col("_n").alias("placements")
    )


def frames_summary(log: DataFrame, frames: DataFrame) -> DataFrame:
    """``frames`` plus the most placed colour and the most painted cell of every frame, as ``frame_modes`` finds them."""
    colors = frame_modes(log, frames.select("frame_start", "frame_end").distinct(), "pixel_color")
    cells = frame_modes(log, frames.select("frame_start", "frame_end").distinct(), "coordinate")
    colors = colors.withColumnsRenamed({"pixel_color": "most_color", "placements": "color_placements"})
    cells = cells.withColumnsRenamed({"coordinate": "most_pixel", "placements": "pixel_placements"})
    both = colors.join(cells, ["frame_start", "frame_end"])
    own = frames.alias("f")
    same = F.expr("f.frame_start <=> t.frame_start and f.frame_end <=> t.frame_end")
    tops = [f"t.{c}" for c in ("most_color", "color_placements", "most_pixel", "pixel_placements")]
    return own.join(both.alias("t"), same, "left").select("f.*", *tops)
