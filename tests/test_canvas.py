import pytest

import pixeltide as px
from helpers import make_log, rows_of

RED, BLUE, W = "#FF4500", "#2450A4", "#FFFFFF"


def test_rewritten_cell(spark):
    log = make_log(spark, [(1, 1, RED, 3, 4), (1, 2, BLUE, 3, 4)])
    assert rows_of(px.final_cells(log)) == [(3, 4, BLUE)]
    assert rows_of(px.final_cells(log, "earliest")) == [(3, 4, RED)]


def test_rewritten_with_the_same_color_again(spark):
    log = make_log(spark, [(1, 1, RED, 0, 0), (1, 2, BLUE, 0, 0), (1, 3, RED, 0, 0)])
    assert rows_of(px.final_cells(log)) == [(0, 0, RED)]
    assert rows_of(px.final_cells(log, "earliest")) == [(0, 0, RED)]


def test_two_colors_at_one_instant(spark):
    log = make_log(spark, [(1, 1, RED, 0, 0), (2, 1, BLUE, 0, 0)])
    assert rows_of(px.final_cells(log)) == [(0, 0, RED)]
    assert rows_of(px.final_cells(log, "earliest")) == [(0, 0, BLUE)]


def test_unknown_policy(spark):
    with pytest.raises(ValueError):
        px.final_cells(make_log(spark, []), "newest")


def test_region_has_offsets_rgb_and_its_edges(spark):
    log = make_log(
        spark,
        [(1, 1, RED, 8, 9), (1, 1, BLUE, 12, 13), (1, 1, W, 13, 11), (1, 1, W, 7, 11)]
        + [(1, 86400 * 4, W, 8, 9)],
    )
    region = px.canvas_region(log, 10, 11, 2, "2022-04-01 00", "2022-04-04 00")
    assert rows_of(region) == [(12, 13, 4, 4, BLUE, 36, 80, 164), (8, 9, 0, 0, RED, 255, 69, 0)]
    assert rows_of(px.canvas_region(log, 10, 11, 2), "x", "y", "pixel_color") == [(12, 13, BLUE), (8, 9, W)]


def test_region_needs_both_ends_of_the_frame(spark):
    with pytest.raises(ValueError):
        px.canvas_region(make_log(spark, []), 0, 0, 1, start="2022-04-01 00")


def test_dense_grid(spark):
    log = make_log(spark, [(1, 1, RED, 6, 8)])
    grid = px.dense_grid(px.final_cells(log), 5, 7, 3, 2)
    rows = rows_of(grid)
    assert len(rows) == 6
    assert (6, 8, 1, 1, RED, 255, 69, 0) in rows
    assert sum(r[4] == "#000000" for r in rows) == 5
    assert {(r[0], r[1]) for r in rows} == {(x, y) for x in (5, 6, 7) for y in (7, 8)}


def test_user_canvas_is_white_and_keeps_the_first(spark):
    log = make_log(
        spark,
        [(1, 1, RED, 0, 0), (1, 2, BLUE, 0, 0), (2, 0, BLUE, 0, 0), (2, 0, BLUE, 1, 1), (1, 3, RED, None, 1)],
    )
    busiest = px.top_users(log, 1)
    canvas = rows_of(px.user_canvas(log, busiest, 2, 2), "x", "y", "pixel_color")
    assert canvas == [(0, 0, RED), (0, 1, W), (1, 0, W), (1, 1, W)]
    latest = rows_of(px.user_canvas(log, busiest, 2, 2, policy="latest"), "x", "y", "pixel_color")
    assert latest[0] == (0, 0, BLUE)


def test_hex_to_rgb(spark):
    df = spark.createDataFrame([("#FFA800",), ("ffa800",), ("#12345",), ("red",), (None,)], "c string")
    got = [tuple(r) for r in df.select(*px.hex_to_rgb("c")).collect()]
    assert got == [(255, 168, 0), (255, 168, 0)] + [(None, None, None)] * 3


def test_palette(spark):
    names = {r.pixel_color: r.color for r in px.color_names_table(spark).collect()}
    assert len(names) == 32 and len(set(names.values())) == 31
    assert names["#E4ABFF"] == "Pale violet"


def test_a_placement_outside_the_canvas_is_an_error_unless_clipped(spark):
    log = make_log(spark, [(1, 1, RED, 0, 0), (1, 2, BLUE, 2500, 0)])
    with pytest.raises(Exception, match="outside the canvas: ?,?2500,0"):
        px.user_canvas(log, [1]).collect()
    clipped = px.user_canvas(log, [1], 2, 1, clip=True)
    assert rows_of(clipped, "x", "y", "pixel_color") == [(0, 0, RED), (1, 0, W)]


def test_a_placement_without_time_wins_no_cell(spark):
    log = make_log(spark, [(1, None, W, 0, 0), (1, 5, "#000000", 0, 0), (1, None, RED, 1, 1)])
    for policy in ("earliest", "latest"):
        assert rows_of(px.final_cells(log, policy)) == [(0, 0, "#000000")]
