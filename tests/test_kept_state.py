"""Kept first placements, canvas snapshots and sessions against the operators over the whole log."""

import random
from datetime import datetime, timedelta

import pytest

import pixeltide as px
from pixeltide.sources.schema import CLEAN

START = datetime(2024, 3, 9, 20)


def log_rows(seed, n=300):
    rng = random.Random(seed)
    rows = [
        (START + timedelta(seconds=rng.randrange(4 * 86400), microseconds=rng.randrange(3)), rng.choice([None, *range(9)]),
         rng.choice([None, "#AA0000", "#00BB00", "#0000CC"]), rng.randrange(4), rng.randrange(3))
        for _ in range(n)
    ]
    return [*rows, *rows[:20], (None, 1, "#AA0000", 0, 0), (None, 99, "#AA0000", 3, 2)]


@pytest.fixture(scope="module")
def rows():
    return log_rows(5)


@pytest.mark.parametrize("seed", [1, 2])
def test_first_placements_equal_the_scan_after_any_split(spark, tmp_path, rows, seed):
    rng = random.Random(seed)
    parts = [[] for _ in range(4)]
    for row in rows:
        rng.choice(parts).append(row)
    kept = px.kept_first_placements(spark, str(tmp_path / "kept"))
    with pytest.raises(ValueError):
        kept.read()
    for n, part in enumerate([*parts, []]):
        assert kept.load(f"load {n}", spark.createDataFrame(part, CLEAN))
        assert not kept.load(f"load {n}", spark.createDataFrame(part, CLEAN))
    whole = spark.createDataFrame(rows, CLEAN)
    assert sorted(kept.read().collect(), key=repr) == sorted(px.first_placements(whole).collect(), key=repr)
    for hours in ((0, 5), (1, 90), (200, 300)):
        start, end = (START + timedelta(hours=h) for h in hours)
        for inclusive in (True, False):
            wanted = px.count_first_time_users(whole, start, end, inclusive).first()[0]
            assert px.count_first_time_users_of(kept.read(), start, end, inclusive).first()[0] == wanted


def test_a_load_that_dies_leaves_the_version_before_it(spark, tmp_path, rows):
    kept = px.kept_first_placements(spark, str(tmp_path / "kept"))
    first, second = (spark.createDataFrame(part, CLEAN) for part in (rows[:100], rows[100:]))
    kept.load("one", first)
    before = sorted(kept.read().collect(), key=repr)
    # The rows of the second load are there, its mark is not.
    kept.merge(kept.read().unionByName(kept.fold(second))).write.parquet(str(tmp_path / "kept/version=2/rows"))
    assert kept.versions() == [1] and kept.loads() == ["one"] and sorted(kept.read().collect(), key=repr) == before
    assert kept.load("two", second) and kept.loads() == ["one", "two"]
    whole = spark.createDataFrame(rows, CLEAN)
    assert sorted(kept.read().collect(), key=repr) == sorted(px.first_placements(whole).collect(), key=repr)
    for n in range(3):
        kept.load(f"more {n}", first)
    assert len(kept.versions()) == 2


def cells(df):
    return sorted((r.x, r.y, r.pixel_color) for r in df.collect())


def test_canvas_at_any_moment(spark, tmp_path, rows):
    path = str(tmp_path / "log")
    px.write_log(spark.createDataFrame(rows, CLEAN), path, folders="hour")
    log = px.read_log(spark, path)
    history = px.CanvasHistory(log, str(tmp_path / "canvas"))
    days = px.days_between(START, START + timedelta(days=4))
    moments = [START, *days, *(START + timedelta(seconds=random.Random(7).randrange(4 * 86400)) for _ in range(3)), START + timedelta(days=9)]
    wanted = {m: cells(px.final_cells(log.where(f"timestamp < timestamp_ntz'{m}'"))) for m in moments}
    assert cells(history.at(days[1])) == wanted[days[1]]
    assert all(history.snapshot(d) for d in (days[0], days[2])) and not history.snapshot(days[2])
    with pytest.raises(ValueError):
        history.snapshot(days[1])
    for m in moments:
        assert cells(history.at(m)) == wanted[m]
    assert cells(history.region(moments[-1], 1, 1, 0)) == [c for c in wanted[moments[-1]] if c[:2] == (1, 1)]


def test_replay_reads_the_snapshot_and_the_folders_after_it(spark, tmp_path, rows):
    path = str(tmp_path / "log")
    px.write_log(spark.createDataFrame(rows, CLEAN), path, folders="day")
    history = px.CanvasHistory(px.read_log(spark, path), str(tmp_path / "canvas"))
    day = px.days_between(START, START + timedelta(days=3))[2]
    history.snapshot(day)
    later = history.at(day + timedelta(hours=5))
    later.collect()
    plan = later._jdf.queryExecution().toString()
    assert f"placed_day#" in plan and f">= {day:%Y%m%d}" in plan.replace("placed_day", "placed_day")
    assert plan.count("Scan parquet") >= 2


@pytest.mark.parametrize("cuts", [(), (30,), (10, 11, 40), (5, 48, 49, 50, 51, 90)])
def test_sessions_for_any_cut(spark, tmp_path, rows, cuts):
    gap = 7200  # sessions go over three loads
    history = px.SessionHistory(spark, str(tmp_path / "sessions"), gap)
    borders = [*(START + timedelta(hours=h) for h in cuts), START + timedelta(days=30)]
    before = datetime.min
    for border in borders:
        part = [r for r in rows if r[0] and before <= r[0] < border]
        assert history.load(border, spark.createDataFrame(part, CLEAN))
        before = border
    assert not history.load(borders[0], spark.createDataFrame(rows, CLEAN))
    wanted = px.sessionize(spark.createDataFrame([r for r in rows if r[0]], CLEAN), gap).drop("session_id")
    found = history.sessions().select(*wanted.columns)
    assert sorted(found.collect(), key=repr) == sorted(wanted.collect(), key=repr)


def test_a_load_must_hold_its_own_time(spark, tmp_path, rows):
    history = px.SessionHistory(spark, str(tmp_path / "sessions"))
    early = [r for r in rows if r[0] and r[0] < START + timedelta(days=1)]
    assert history.load(START + timedelta(days=1), spark.createDataFrame(early, CLEAN))
    with pytest.raises(Exception, match="outside the load"):
        history.load(START + timedelta(days=2), spark.createDataFrame(early, CLEAN))
    assert len(history.borders()) == 1
    with pytest.raises(ValueError):
        history.load(START, spark.createDataFrame(early, CLEAN))
