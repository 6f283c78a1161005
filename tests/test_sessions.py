"""Sessions, checked against their definition and Spark's own session window."""

import random

import pytest
from pyspark.sql import functions as F

import pixeltide as px
from helpers import at, make_log, rows_of

START, END = "2022-04-01 12", "2022-04-01 18"
B = "#000000"

def by_definition(log, gap):
    """(user, time, session) of every placement: it opens a session if its user has none in the ``gap`` before it."""
    rows = [(r.user_id_hashed, r.timestamp) for r in log.collect() if r.timestamp is not None]
    out = []
    for user in {u for u, _ in rows}:
        times = sorted(t for u, t in rows if u == user)
        opened = {t for t in times if not any(0 < (t - s).total_seconds() <= gap for s in times)}
        out += [(user, t, sum(o <= t for o in opened)) for t in times]
    return out


def random_log(spark, seed, users=6, rows=1500, span=86400):
    rng = random.Random(seed)
    made = []
    for _ in range(rows):
        # User 1 places a third of everything; a quarter falls on full quarter hours.
        user = 1 if rng.random() < 0.34 else rng.randrange(2, users + 2)
        second = rng.random() * span * (1 if user == 1 else 3)
        if rng.random() < 0.25:
            second = round(second / 900) * 900
        made.append((user, round(second, 6), B, 0, 0))
    return make_log(spark, made + made[:50])


@pytest.mark.parametrize("second, sessions", [(899, 1), (900, 1), (900.5, 2), (901, 2)])
@pytest.mark.parametrize("offset", [0, 1, 449.5, 899])
def test_gap_edge(spark, second, sessions, offset):
    log = make_log(spark, [(1, offset, B, 0, 0), (1, offset + second, B, 0, 0)])
    assert px.sessionize(log).count() == sessions


def test_sessions_chain_over_many_windows(spark):
    log = make_log(spark, [(1, i * 800, B, 0, 0) for i in range(50)])
    assert rows_of(px.sessionize(log)) == [(1, 1, at(0), at(49 * 800), 50, 49 * 800.0)]


def test_lone_placements_are_not_averaged(spark):
    log = make_log(spark, [(1, 0, B, 0, 0), (2, 0, B, 0, 0), (2, 10.5, B, 0, 0)])
    assert rows_of(px.average_session_length(log, START, END)) == [(10.5, 1)]
    lone = px.average_session_length(log.filter("user_id_hashed = 1"), START, END)
    assert rows_of(lone) == [(None, 0)]


def test_two_placements_at_one_instant_are_a_session_of_length_zero(spark):
    log = make_log(spark, [(1, 0, B, 0, 0), (1, 0, B, 1, 0)])
    assert rows_of(px.average_session_length(log, START, END)) == [(0.0, 1)]
    assert rows_of(px.session_flags(log)) == [(1, at(0), 2, 1)]


def test_the_frame_cuts_sessions(spark):
    log = make_log(spark, [(1, s, B, 0, 0) for s in (-300, 0, 300, 21600, 21900)])
    # Only 0, 300 and 21600 are inside; the last is alone in its session.
    assert rows_of(px.average_session_length(log, START, END)) == [(300.0, 1)]


def test_unparsed_timestamps_are_in_no_session(spark):
    log = make_log(spark, [(1, None, B, 0, 0), (1, 0, B, 0, 0)])
    assert rows_of(px.sessionize(log), "placements") == [(1,)]
    assert rows_of(px.session_flags(log), "placements") == [(1,)]
    assert px.session_assignments(log).count() == 1


@pytest.mark.parametrize("gap", [60, 900, 21600])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_definition(spark, seed, gap):
    log = random_log(spark, seed, rows=600)
    wanted = by_definition(log, gap)
    got = px.session_assignments(log, gap)
    assert rows_of(got, "user_id_hashed", "timestamp", "session_id") == sorted(wanted, key=repr)
    sessions = {}
    for user, time, number in wanted:
        sessions.setdefault((user, number), []).append(time)
    rows = [(u, n, min(ts), max(ts), len(ts)) for (u, n), ts in sessions.items() if len(ts) > 1]
    columns = ["user_id_hashed", "session_id", "session_start", "session_end", "placements"]
    assert rows_of(px.session_durations(log, gap), *columns) == sorted(rows, key=repr)
    flags = {(u, t): [0, int(t == min(sessions[u, n]))] for u, t, n in wanted}
    for user, time, _ in wanted:
        flags[user, time][0] += 1
    columns = ["user_id_hashed", "timestamp", "placements", "new_session"]
    assert rows_of(px.session_flags(log, gap), *columns) == sorted(((*k, *v) for k, v in flags.items()), key=repr)


def test_a_null_user_is_a_user(spark):
    log = make_log(spark, [(None, 0, B, 0, 0), (None, 60, B, 0, 0), (1, 30, B, 0, 0)])
    assert rows_of(px.sessionize(log), "user_id_hashed", "placements") == [(1, 1), (None, 2)]
    assert rows_of(px.session_assignments(log), "user_id_hashed", "session_id") == [(1, 1), (None, 1), (None, 1)]
    flags = rows_of(px.session_flags(log), "user_id_hashed", "timestamp", "new_session")
    assert flags == [(1, at(30), 1), (None, at(0), 1), (None, at(60), 0)]


@pytest.mark.parametrize("gap", [0, -1, 900.7, True])
def test_the_gap_is_whole_seconds(spark, gap):
    with pytest.raises(ValueError):
        px.sessionize(make_log(spark, []), gap)


def test_equals_session_window(spark):
    log = random_log(spark, 3)
    built_in = (
        log.groupBy("user_id_hashed", F.session_window("timestamp", "900 seconds"))
        .agg(F.min("timestamp"), F.max("timestamp"), F.count("*"))
        .drop("session_window")
    )
    columns = ["user_id_hashed", "session_start", "session_end", "placements"]
    assert rows_of(px.sessionize(log), *columns) == rows_of(built_in)


def test_average_is_that_of_the_durations(spark):
    log = random_log(spark, 4)
    inside = px.within_frame(log, START, END, end_inclusive=True)
    seconds = [r.session_seconds for r in px.session_durations(inside).collect()]
    got = px.average_session_length(log, START, END).first()
    assert got.sessions == len(seconds)
    assert got.avg_session_seconds == pytest.approx(sum(seconds) / len(seconds))
