from datetime import datetime

import pytest

import pixeltide as px
from helpers import at, make_log, rows_of
from pixeltide.functions.time import as_moment, as_range, hour_frames

START, END = "2022-04-01 12", "2022-04-01 13"
W, B = "#FFFFFF", "#000000"


def test_hour_text_and_iso_text_are_moments():
    assert as_moment("2022-04-01 12") == datetime(2022, 4, 1, 12)
    assert as_moment("2022-04-01 12:30:00.5") == datetime(2022, 4, 1, 12, 30, 0, 500000)
    assert as_moment("2022-04-01 12:00:00+02:00") == datetime(2022, 4, 1, 10)


@pytest.mark.parametrize("end", ["2022-04-01 12", "2022-04-01 11"])
def test_end_must_be_after_start(end):
    with pytest.raises(ValueError):
        as_range(START, end)


@pytest.mark.parametrize("hours", [(), (0,), (1, 1)])
def test_frames_need_distinct_positive_hours(hours):
    with pytest.raises(ValueError):
        hour_frames(START, hours)


def test_end_of_frame_is_out_unless_inclusive(spark):
    log = make_log(spark, [(1, 0, B, 0, 0), (1, 3600, W, 0, 0), (1, 3600, W, 0, 0)])
    assert rows_of(px.mode_in_frame(log, "pixel_color", START, END)) == [(B, 1)]
    assert rows_of(px.mode_in_frame(log, "pixel_color", START, END, end_inclusive=True)) == [(W, 2)]
    by_frame = px.timeframe_modes(log, "pixel_color", START, (1,), end_inclusive=True)
    assert rows_of(by_frame, "pixel_color", "placements") == [(W, 2)]


def test_smallest_key_wins_a_tie(spark):
    log = make_log(spark, [(1, 1, W, 2, 1), (1, 2, B, 10, 1), (1, 3, W, 2, 1), (1, 4, B, 10, 1)])
    assert rows_of(px.mode_in_frame(log, "pixel_color", START, END)) == [(B, 2)]
    # Text order decides: "10,1" comes before "2,1".
    assert rows_of(px.mode_coordinate_in_frame(log, START, END)) == [("10,1", 2)]
    summary = px.timeframe_summary(log, START, (1,))
    assert rows_of(summary, "most_color", "most_pixel") == [(B, "10,1")]


def test_null_keys_do_not_win_but_count(spark):
    log = make_log(spark, [(1, 1, None, None, 0)] * 3 + [(1, 2, W, 4, 5)])
    assert rows_of(px.mode_in_frame(log, "pixel_color", START, END)) == [(W, 1)]
    assert rows_of(px.mode_coordinate_in_frame(log, START, END)) == [("4,5", 1)]
    assert rows_of(px.timeframe_summary(log, START, (1,)), "most_color", "most_pixel") == [(W, "4,5")]
    assert (None, 3) in rows_of(px.count_by(log, "pixel_color"))


def test_unparsed_timestamp_is_in_no_frame(spark):
    log = make_log(spark, [(1, None, W, 0, 0), (1, None, W, 0, 0), (1, 5, B, 0, 0)])
    assert rows_of(px.mode_in_frame(log, "pixel_color", START, END)) == [(B, 1)]


def test_empty_frame(spark):
    log = make_log(spark, [(1, -5, W, 0, 0)])
    assert rows_of(px.mode_in_frame(log, "pixel_color", START, END)) == []
    summary = px.timeframe_summary(log, START)
    assert rows_of(summary, "hours", "most_color", "most_pixel", "pixel_placements") == [
        (1, None, None, None),
        (3, None, None, None),
        (6, None, None, None),
    ]


def test_summary_equals_the_single_frames(spark):
    rows = [(i % 7, i * 97 % 21600, (W, B, "#FF4500")[i * i % 3], i * 13 % 5, i % 3) for i in range(400)]
    log = make_log(spark, rows)
    summary = {r.hours: r for r in px.timeframe_summary(log, START).collect()}
    for frame in hour_frames(START):
        hours = int(frame.name.split("-")[0])
        color = px.mode_in_frame(log, "pixel_color", START, frame.end).first()
        cell = px.mode_coordinate_in_frame(log, START, frame.end).first()
        got = summary[hours]
        assert (got.most_color, got.color_placements) == (color.pixel_color, color.placements)
        assert (got.most_pixel, got.pixel_placements) == (cell.coordinate, cell.placements)
        assert (got.name, got.frame_start, got.frame_end) == frame
        assert got.timeframe == f"{frame.start} to {frame.end}"


def test_text_coordinates_keep_four_parts(spark):
    raw = spark.createDataFrame(
        [("2022-04-01 12:00:01 UTC", "a", W, "1,2,3,4")] * 2 + [("2022-04-01 12:00:02.5 UTC", "b", W, "1,2")],
        "timestamp string, user_id string, pixel_color string, coordinate string",
    )
    timed = px.timed_raw_log(raw)
    assert rows_of(px.mode_coordinate_in_frame(timed, START, END)) == [("1,2,3,4", 2)]
    assert rows_of(px.timeframe_summary(timed, START, (1,)), "most_pixel") == [("1,2,3,4",)]
    assert rows_of(px.mode_coordinate_in_frame(px.clean_log(raw), START, END)) == [("1,2", 3)]


def test_seconds_between_ignores_clock_changes_of_the_session_zone(spark):
    # 02:00 to 03:00 does not exist on this day in the zone of the session.
    df = spark.sql("select timestamp_ntz'2022-03-13 01:30:00.25' a, timestamp_ntz'2022-03-13 03:30:00' b")
    assert df.select(px.seconds_between("a", "b")).first()[0] == 7199.75


def test_frame_inside_missing_hour_of_the_session_zone(spark):
    log = spark.sql("select timestamp_ntz'2022-03-13 02:30:00' as timestamp, '#000000' as pixel_color")
    assert px.within_frame(log, "2022-03-13 02", "2022-03-13 03").count() == 1
    assert at(0) == datetime(2022, 4, 1, 12)
