"""Frames by an interval join, against the frames counted one by one."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import pixeltide as px
from pixeltide.sources.schema import CLEAN
from workload.placements import placements

START = datetime(2024, 3, 9, 22)  # the tests' session zone changes its clock the next morning


@pytest.fixture(scope="module")
def log(spark):
    rows = []
    for i in range(400):
        at = START + timedelta(seconds=97 * i * (i % 7), microseconds=i % 3)
        rows.append((at, i % 11, (None, "#AA0000", "#00BB00", "#0000CC")[i * i % 4], i % 3, i % 2))
    return spark.createDataFrame([*rows, (None, 1, "#AA0000", 0, 0)], CLEAN)


def frames_of(spark, spans):
    return spark.createDataFrame([(n, *s) for n, s in enumerate(spans)], "name int, frame_start timestamp_ntz, frame_end timestamp_ntz")


def test_any_frames_equal_single_frames(spark, log):
    hour, second = timedelta(hours=1), timedelta(seconds=1)
    spans = [(START + k * hour / 3, START + (k / 3 + 1 + k % 5) * hour) for k in range(40)]
    spans += [spans[3], (START + 97 * second, START + 97 * second + timedelta(microseconds=1)), (START - 90 * hour, START + 900 * hour)]
    found = {r.name: r for r in px.frame_modes(log, frames_of(spark, spans), "pixel_color").collect()}
    cells = {r.name: r for r in px.frame_modes(log, frames_of(spark, spans), "coordinate").collect()}
    rows = log.collect()
    for n, (first, last) in enumerate(spans):
        inside = [r for r in rows if r.timestamp and first <= r.timestamp < last]
        for got, keys in ((found[n].pixel_color, [r.pixel_color for r in inside]), (cells[n].coordinate, [f"{r.x},{r.y}" for r in inside])):
            known = [k for k in keys if k]
            assert got == min(set(known), key=lambda k: (-known.count(k), k), default=None)
        assert found[n].placements == (max(map([r.pixel_color for r in inside].count, {found[n].pixel_color})) if found[n].pixel_color else None)


def test_frames_without_rows_order_or_border(spark, log):
    day = timedelta(days=1)
    spans = [(START - 9 * day, START - 8 * day), (START, START), (START + day, START), (None, START), (START, None)]
    found = px.frames_summary(log, frames_of(spark, spans)).collect()
    assert len(found) == 5 and all(r.most_color is None and r.most_pixel is None for r in found)
    none = frames_of(spark, spans).where("false")
    assert px.frame_modes(log, none, "pixel_color").collect() == []
    assert px.frame_modes(log.where("false"), frames_of(spark, spans[:1]), "pixel_color").count() == 1


def test_plan_does_not_grow_with_the_frames(spark, sf_dir):
    log = placements(spark, sf_dir)

    def plan(end):
        df = px.frame_modes(log, px.sliding_frames(spark, "2024-01-01 00", end, 6), "pixel_color")
        return df._jdf.queryExecution().executedPlan().toString()

    few, many = plan("2024-01-01 03"), plan("2024-06-01 00")
    # Joins may be of another kind, as the table of frames has another size.
    assert abs(len(few.splitlines()) - len(many.splitlines())) <= 6
    assert few.count("Join") == many.count("Join") and few.count("Scan") == many.count("Scan")
    assert "NestedLoop" not in many and "Cartesian" not in many


def test_sliding_frames(spark):
    rows = px.sliding_frames(spark, "2024-03-10 00", "2024-03-10 05", 6, 2).orderBy("frame_start").collect()
    assert [r.frame_start.hour for r in rows] == [0, 2, 4] and all(r.frame_end - r.frame_start == timedelta(hours=6) for r in rows)
    with pytest.raises(ValueError):
        px.sliding_frames(spark, "2024-03-10 00", "2024-03-10 05", 0)


def test_a_frame_of_several_frames_is_the_summary(spark, sf_dir):
    log = placements(spark, sf_dir)
    wanted = px.timeframe_summary(log, "2024-01-05 12", (24, 72)).select("frame_start", "frame_end", "most_color", "color_placements", "most_pixel", "pixel_placements")
    frames = wanted.select("frame_start", "frame_end")
    found = px.frames_summary(log, frames)
    assert sorted(found.collect()) == sorted(wanted.collect())
    assert found.select(F.count("*")).first()[0] == 2
