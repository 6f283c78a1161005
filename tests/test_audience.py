import pytest

import pixeltide as px
from helpers import make_log, rows_of

START, END = "2022-04-01 12", "2022-04-01 18"
W, B = "#FFFFFF", "#000000"


def test_rank_counts_users_once_and_keeps_shared_names_apart(spark):
    log = make_log(
        spark,
        [(1, 1, "#00A368", 0, 0), (1, 2, "#00A368", 0, 0), (2, 3, "#00A368", 0, 0)]
        + [(1, 4, "#00756F", 0, 0)]
        + [(u, 5, "#123456", 0, 0) for u in (1, 2, 3)]
        + [(9, 7 * 3600, B, 0, 0)],
    )
    assert rows_of(px.rank_colors_by_distinct_users(log, START, END)) == [
        (1, "#123456", "Unknown", 3),
        (2, "#00A368", "Dark cyan 2", 2),
        (3, "#00756F", "Dark cyan 2", 1),
    ]


def test_null_color_is_ranked_as_unknown(spark):
    log = make_log(spark, [(1, 1, None, 0, 0)])
    assert rows_of(px.rank_colors_by_distinct_users(log, START, END)) == [(1, None, "Unknown", 1)]


def test_first_time_users_look_at_the_whole_history(spark):
    log = make_log(
        spark,
        [(1, -3600, B, 0, 0), (1, 3600, B, 0, 0)]  # was there before the frame
        + [(2, 0, B, 0, 0), (2, 30 * 3600, B, 0, 0)]  # first at its start
        + [(3, 6 * 3600, B, 0, 0)]  # first at its end
        + [(4, 6 * 3600 + 1, B, 0, 0)],  # after it
    )
    assert px.count_first_time_users(log, START, END).first()[0] == 2
    assert px.count_first_time_users(log, START, END, end_inclusive=False).first()[0] == 1


def test_percentiles_interpolate(spark):
    rows = [(user, i, B, 0, 0) for user, n in ((1, 1), (2, 2), (3, 3), (4, 10)) for i in range(n)]
    values = px.placement_percentiles(make_log(spark, rows), START, END)
    got = values.orderBy("percentile").collect()
    assert [r.placements for r in got] == pytest.approx([2.5, 4.75, 7.9, 9.79])
    assert [r.whole_placements for r in got] == [2, 4, 7, 9]


def test_percentiles_of_an_empty_frame_are_null(spark):
    values = px.placement_percentiles(make_log(spark, []), START, END, (0.5, 0.9))
    assert rows_of(values, "percentile", "placements") == [(0.5, None), (0.9, None)]


def test_report_has_all_four_answers(spark):
    log = make_log(spark, [(1, 0, B, 0, 0), (1, 100, W, 0, 0), (2, 50, B, 0, 0)])
    report = px.frame_report(log, START, END)
    assert report.average_session.first().avg_session_seconds == 100.0
    table = rows_of(report.as_table())
    assert ("color_users", 1, "Black", 2.0) in table
    assert ("first_time_users", 1, None, 2.0) in table
    assert ("average_session_seconds", 1, None, 100.0) in table
    assert ("placement_percentile", 50, None, 1.5) in table
    assert len(table) == 2 + 1 + 4 + 1
