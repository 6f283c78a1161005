import pytest

import pixeltide as px
from helpers import at, make_log, rows_of

RED, BLUE, W, B = "#FF4500", "#2450A4", "#FFFFFF", "#000000"


@pytest.fixture
def log(spark):
    rows = [(1, i, c, 0, 0) for i, c in enumerate([RED] * 4 + [BLUE] * 3 + [W] * 3 + [B])]
    rows += [(2, i, "#123456", 5, 6) for i in range(3)] + [(3, 0, W, 6, 5), (3, 1, W, 6, 4)]
    return make_log(spark, rows)


def test_top_pixels_with_ties(log):
    assert rows_of(px.top_pixels(log, 3)) == [(0, 0, 11), (5, 6, 3), (6, 4, 1)]


def test_top_colors_of_given_and_of_hottest_cells(log):
    expected = [
        (0, 0, 1, RED, "Orange", 4),
        (0, 0, 2, BLUE, "Dark blue", 3),
        (0, 0, 3, W, "White", 3),
        (5, 6, 1, "#123456", "Unknown", 3),
    ]
    typed_in = px.top_colors_per_pixel(log, [(0, 0), (5, 6), (99, 99)])
    assert [tuple(r) for r in typed_in.collect()] == expected
    assert rows_of(px.top_colors_per_pixel(log, px.top_pixels(log, 2))) == expected
    assert px.top_colors_per_pixel(log, [(0, 0)], n=None).count() == 4


def test_pixels_are_matched_as_pairs(log):
    assert rows_of(px.at_pixels(log, [(6, 4), (5, 5)]), "x", "y") == [(6, 4)]
    with pytest.raises(ValueError):
        px.at_pixels(log, [])


def test_counts_add_up(log):
    for keys in (["pixel_color"], ["x", "y"], ["user_id_hashed"]):
        assert sum(r.placements for r in px.count_by(log, *keys).collect()) == log.count()
    assert rows_of(px.distinct_pixels(log)) == [(0, 0), (5, 6), (6, 4), (6, 5)]


def test_top_users_and_their_positions(log):
    assert rows_of(px.top_users(log, 2)) == [(1, 11), (2, 3)]
    by_join = px.user_positions(log, px.top_users(log, 2))
    assert rows_of(by_join) == rows_of(px.user_positions(log, [1, 2]))
    assert by_join.columns == ["x", "y", "user_id_hashed", "pixel_color", "timestamp"]


def test_positions_newest_first(log):
    times = [r.timestamp for r in px.user_positions(log, [1], newest_first=True).collect()]
    assert times == sorted(times, reverse=True) and times[0] == at(10)
