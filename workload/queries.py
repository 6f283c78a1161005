"""One query per operator, each over the whole log."""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import pixeltide as px
from pixeltide.functions.time import moment
from pixeltide.sources.schema import CLEAN
from pixeltide.sources.shared_folder import fresh_path
from workload.placements import placements, raw_placements

START, END = "2024-01-05 12", "2024-01-20 18"
HOURS = (24, 72, 168)
SLIDE_START, SLIDE_END, SLIDE_HOURS = "2024-01-01 00", "2024-02-01 00", 6
SESSION_BORDERS, LONG_GAP = ("2024-01-10 12", "2024-01-20 18", "2030-01-01 00"), 6 * 3600
SNAPSHOTS = ("2024-01-03 00", "2024-01-05 00", "2024-01-08 00")
FIRST_START, FIRST_END = "2024-01-01 06", "2024-01-02 00"
CENTER_X, CENTER_Y, RADIUS = 10, 8, 5
WIDTH, HEIGHT = 25, 20
PIXELS = [(0, 0), (12, 5), (7, 11)]
USERS = [3, 14, 15, 92, 65]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


#: Seconds spent on input that a query writes for itself before it does its work.
FIXTURES: list[float] = []


@contextmanager
def _fixture():
    started = time.perf_counter()
    yield
    FIXTURES.append(time.perf_counter() - started)


def _raw_csv(spark, sf_dir) -> str:
    """Path of the raw log as CSV."""
    path = fresh_path(spark, "raw-log")
    with _fixture():
        raw_placements(spark, sf_dir).write.option("header", True).csv(path)
    return path


def _day_log(spark, sf_dir, order="tile"):
    """The clean log, written with day folders and read again."""
    path = fresh_path(spark, "clean-log")
    with _fixture():
        px.write_log(placements(spark, sf_dir), path, folders="day", order=order)
    return px.read_log(spark, path)


def _framed(spark, sf_dir, end_inclusive=True):
    return px.within_frame(placements(spark, sf_dir), START, END, end_inclusive)


# Sources and ingest


@query
def csv_ingest(spark, sf_dir):
    return px.ingest_csv(spark, _raw_csv(spark, sf_dir)).select("timestamp", "pixel_color", "x", "y")


@query
def csv_checked(spark, sf_dir):
    return px.checked_csv(spark, _raw_csv(spark, sf_dir)).select("timestamp", "pixel_color", "x", "y", "reason")


@query
def parquet_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "clean-log")
    px.write_log(placements(spark, sf_dir), path, folders=None)
    return px.read_log(spark, path).select(*CLEAN.fieldNames())


@query
def frame_of_clustered_log(spark, sf_dir):
    return px.within_frame(_day_log(spark, sf_dir), START, END).select(*CLEAN.fieldNames())


@query
def region_of_clustered_log(spark, sf_dir):
    inside = px.within_frame(_day_log(spark, sf_dir), START, END)
    return inside.filter(px.in_box(CENTER_X, CENTER_Y, RADIUS)).select(*CLEAN.fieldNames())


@query
def split_coordinates(spark, sf_dir):
    return raw_placements(spark, sf_dir).select("coordinate", *px.split_coordinate("coordinate"))


@query
def user_hash_cardinality(spark, sf_dir):
    log = px.clean_log(raw_placements(spark, sf_dir))
    return log.agg(F.count_distinct("user_id_hashed").alias("users"))


@query
def parse_timestamps(spark, sf_dir):
    return raw_placements(spark, sf_dir).select(
        F.col("timestamp").alias("text"), px.parse_timestamp("timestamp").alias("timestamp")
    )


# Filters


@query
def filter_half_open(spark, sf_dir):
    return _framed(spark, sf_dir, end_inclusive=False)


@query
def filter_closed(spark, sf_dir):
    return _framed(spark, sf_dir)


@query
def filter_between(spark, sf_dir):
    return placements(spark, sf_dir).filter(F.col("timestamp").between(moment(START), moment(END)))


@query
def filter_bbox(spark, sf_dir):
    return placements(spark, sf_dir).filter(px.in_box(CENTER_X, CENTER_Y, RADIUS))


@query
def filter_tuple_in(spark, sf_dir):
    return px.at_pixels(placements(spark, sf_dir), PIXELS)


@query
def filter_isin(spark, sf_dir):
    return px.user_positions(placements(spark, sf_dir), USERS)


# Sessions


@query
def session_flags(spark, sf_dir):
    return px.session_flags(_framed(spark, sf_dir))


@query
def session_assignments(spark, sf_dir):
    return px.session_assignments(_framed(spark, sf_dir))


@query
def session_durations(spark, sf_dir):
    return px.session_durations(_framed(spark, sf_dir))


@query
def avg_session_length(spark, sf_dir):
    average = px.average_session_length(placements(spark, sf_dir), START, END)
    return average.withColumn("avg_session_seconds", F.round("avg_session_seconds", 6))


@query
def sessions_across_loads(spark, sf_dir):
    """Sessions of the log in three loads, cut where it is dense."""
    log = placements(spark, sf_dir)
    history, before = px.SessionHistory(spark, fresh_path(spark, "sessions"), LONG_GAP), None
    for border in SESSION_BORDERS:
        rows = log.where(F.col("timestamp") < moment(border))
        history.load(border, rows if before is None else rows.where(F.col("timestamp") >= moment(before)))
        before = border
    return history.sessions()


# Counts and modes


@query
def count_by_color(spark, sf_dir):
    return px.count_by(placements(spark, sf_dir), "pixel_color")


@query
def count_by_pixel(spark, sf_dir):
    return px.count_by(placements(spark, sf_dir), "x", "y")


@query
def mode_color(spark, sf_dir):
    return px.mode_in_frame(placements(spark, sf_dir), "pixel_color", START, END)


@query
def mode_coordinate(spark, sf_dir):
    return px.mode_coordinate_in_frame(placements(spark, sf_dir), START, END)


@query
def timeframe_mode_color(spark, sf_dir):
    return px.timeframe_modes(placements(spark, sf_dir), "pixel_color", START, HOURS)


@query
def timeframe_mode_coordinate(spark, sf_dir):
    return px.timeframe_modes(placements(spark, sf_dir), "coordinate", START, HOURS)


@query
def timeframe_summary(spark, sf_dir):
    return px.timeframe_summary(placements(spark, sf_dir), START, HOURS)


@query
def timeframe_summary_csv(spark, sf_dir):
    return px.timeframe_summary(px.timed_raw_log(px.read_raw_csv(spark, _raw_csv(spark, sf_dir))), START, HOURS)


@query
def sliding_frame_modes(spark, sf_dir):
    frames = px.sliding_frames(spark, SLIDE_START, SLIDE_END, SLIDE_HOURS)
    return px.frame_modes(placements(spark, sf_dir), frames, "pixel_color")


@query
def sliding_frame_summary(spark, sf_dir):
    frames = px.sliding_frames(spark, SLIDE_START, SLIDE_END, SLIDE_HOURS)
    return px.frames_summary(placements(spark, sf_dir), frames)


# Audience


@query
def rank_colors(spark, sf_dir):
    return px.rank_colors_by_distinct_users(placements(spark, sf_dir), START, END)


@query
def color_names(spark, sf_dir):
    return px.with_color_names(placements(spark, sf_dir))


@query
def first_time_users(spark, sf_dir):
    return px.count_first_time_users(placements(spark, sf_dir), FIRST_START, FIRST_END)


@query
def first_time_users_kept(spark, sf_dir):
    """The log in three loads, by event and so without order in time, and the answer from one row per user."""
    log = placements(spark, sf_dir, "event_id")
    firsts = px.kept_first_placements(spark, fresh_path(spark, "first-placements"))
    for part in range(3):
        firsts.load(f"part {part}", log.where(F.col("event_id") % 3 == part))
    return px.count_first_time_users_of(firsts.read(), FIRST_START, FIRST_END)


@query
def placement_percentiles(spark, sf_dir):
    values = px.placement_percentiles(placements(spark, sf_dir), START, END)
    return values.withColumn("placements", F.round("placements", 6))


@query
def frame_report(spark, sf_dir):
    table = px.frame_report(placements(spark, sf_dir), START, END).as_table()
    return table.withColumn("value", F.round("value", 6))


# Cells and users


@query
def top_pixels(spark, sf_dir):
    return px.top_pixels(placements(spark, sf_dir), 10)


@query
def top_colors_per_pixel(spark, sf_dir):
    log = placements(spark, sf_dir)
    return px.top_colors_per_pixel(log, px.top_pixels(log, 3), 3)


@query
def pixel_colors(spark, sf_dir):
    return px.top_colors_per_pixel(placements(spark, sf_dir), PIXELS, n=None)


@query
def distinct_pixels(spark, sf_dir):
    return px.distinct_pixels(placements(spark, sf_dir))


@query
def top_users(spark, sf_dir):
    return px.top_users(placements(spark, sf_dir), 50)


@query
def user_positions(spark, sf_dir):
    log = placements(spark, sf_dir)
    return px.user_positions(log, px.top_users(log, 10), newest_first=True)


# Canvas


@query
def canvas_region(spark, sf_dir):
    return px.canvas_region(placements(spark, sf_dir), CENTER_X, CENTER_Y, RADIUS, START, END)


@query
def canvas_region_dense(spark, sf_dir):
    cells = px.canvas_region(placements(spark, sf_dir), CENTER_X, CENTER_Y, RADIUS, START, END)
    return px.dense_grid(cells, 0, 0, WIDTH, HEIGHT)


@query
def user_canvas(spark, sf_dir):
    log = placements(spark, sf_dir)
    return px.user_canvas(log, px.top_users(log, 10), WIDTH, HEIGHT)


@query
def canvas_at_moment(spark, sf_dir):
    """The canvas from a snapshot and the placements after it."""
    history = px.CanvasHistory(_day_log(spark, sf_dir), fresh_path(spark, "canvas"))
    for day in SNAPSHOTS:
        history.snapshot(day)
    return history.at(START)


@query
def hex_to_rgb(spark, sf_dir):
    return px.with_rgb(placements(spark, sf_dir))
