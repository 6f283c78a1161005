from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import pixeltide as px
from helpers import make_log, plan, rows_of
from pixeltide.functions.time import in_frame_once
from pixeltide.sources.schema import CLEAN, DAY, HOUR
from pixeltide.sources.shared_folder import drop_all, fresh_path, shared_folder, stored

LINES = """timestamp,user_id,pixel_color,coordinate
2022-04-01 12:00:00.123 UTC,0012,#FFFFFF,"1,2"
2022-04-01 12:00:01 UTC,7,#000000,"1,2,3,4"
bad,7,#000000,"5,6"
"""
# The same rows with the columns in another order.
REORDERED = """coordinate,timestamp,pixel_color,user_id
"1,2",2022-04-01 12:00:00.123 UTC,#FFFFFF,0012
"1,2,3,4",2022-04-01 12:00:01 UTC,#000000,7
"5,6",bad,#000000,7
"""


@pytest.mark.parametrize("text", [LINES, REORDERED])
def test_ingest_goes_by_column_name(spark, tmp_path, text):
    (tmp_path / "log.csv").write_text(text)
    log = px.ingest_csv(spark, str(tmp_path / "log.csv"))
    assert log.schema.simpleString() == CLEAN.simpleString()
    assert rows_of(log, "timestamp", "pixel_color", "x", "y") == [
        (None, "#000000", 5, 6),
        (datetime(2022, 4, 1, 12, 0, 0, 123000), "#FFFFFF", 1, 2),
        (datetime(2022, 4, 1, 12, 0, 1), "#000000", 1, 2),
    ]
    # Hashed as text: "0012" keeps its zeros.
    hashed = {r[0] for r in log.select("user_id_hashed").collect()}
    expected = spark.sql("select xxhash64('0012'), xxhash64('7')").first()
    assert hashed == set(expected)


def test_files_with_different_headers_fail(spark, tmp_path):
    (tmp_path / "a.csv").write_text(LINES)
    (tmp_path / "b.csv").write_text(REORDERED)
    with pytest.raises(Exception, match="(?i)header"):
        px.ingest_csv(spark, str(tmp_path)).collect()


def test_broken_coordinates(spark):
    raw = spark.createDataFrame(
        [("2022-04-01 12:00:00 UTC", "a", "#000000", "1")],
        "timestamp string, user_id string, pixel_color string, coordinate string",
    )
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        px.clean_log(raw).collect()
    assert rows_of(px.clean_log(raw, strict_coordinates=False), "x", "y") == [(1, None)]


def test_strict_timestamps(spark):
    df = spark.createDataFrame([("bad",)], "t string")
    assert df.select(px.parse_timestamp("t")).first()[0] is None
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.select(px.parse_timestamp("t", strict=True)).collect()


def test_only_the_utc_forms_are_timestamps(spark):
    texts = ["2022", "2022-04-01", "2022-04-01 12:00:00", "2022-04-01 12:00:00+02:00", "2022-04-01T12:00:00 UTC",
             "2022-13-01 12:00:00 UTC", "2022-04-01 12:00:00.1234567 UTC", " 2022-04-01 12:00:00 UTC", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(px.parse_timestamp("t")).collect()] == [None] * len(texts)
    good = spark.createDataFrame([("2022-04-01 12:00:00.5 UTC",), ("2022-04-01 12:00:00.123456 UTC",), (None,)], "t string")
    wanted = [datetime(2022, 4, 1, 12, 0, 0, 500000), datetime(2022, 4, 1, 12, 0, 0, 123456), None]
    for strict in (False, True):
        assert [r[0] for r in good.select(px.parse_timestamp("t", strict)).collect()] == wanted


def test_offsets_are_converted_on_demand(spark):
    texts = ["2022-04-01 12:00:00.25+02:00", "2022-04-01 12:00:00 -0530", "2022-04-01 12:00:00Z", "2022-04-01 12:00:00.5 UTC", "2022", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(px.parse_timestamp("t", offsets=True)).collect()]
    assert got == [
        datetime(2022, 4, 1, 10, 0, 0, 250000), datetime(2022, 4, 1, 17, 30), datetime(2022, 4, 1, 12),
        datetime(2022, 4, 1, 12, 0, 0, 500000), None, None,
    ]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.select(px.parse_timestamp("t", strict=True, offsets=True)).collect()


@pytest.mark.parametrize("inclusive", [False, True])
def test_the_single_comparison_equals_the_range(spark, inclusive):
    frame = "2022-04-01 12:00:00.000001", "2022-04-01 13:00:00.000004"
    times = [datetime(2022, 4, 1, 12, 0, 0, k) for k in range(4)] + [datetime(2022, 4, 1, 13, 0, 0, k) for k in range(7)]
    df = spark.createDataFrame([(t,) for t in (*times, None)], "t timestamp_ntz")
    one, two = (df.filter(f("t", *frame, inclusive)) for f in (in_frame_once, px.in_frame))
    assert rows_of(one) == rows_of(two) and one.count() == (8 if inclusive else 7)


def test_a_column_that_only_has_the_name_of_a_folder_changes_nothing(spark, tmp_path):
    stale = make_log(spark, [(1, 0, "#000000", 1, 2)]).withColumn(DAY, F.lit(19990101)).withColumn(HOUR, F.lit(1))
    frame = "2022-04-01 11", "2022-04-01 13"
    assert px.within_frame(stale, *frame).count() == 1
    px.write_log(stale, str(tmp_path / "log"), "day")
    log = px.read_log(spark, str(tmp_path / "log"))
    moved = log.withColumn("timestamp", F.col("timestamp") + F.expr("interval 2 days"))
    assert px.within_frame(moved, "2022-04-03 11", "2022-04-03 13").count() == 1
    overwritten = log.withColumn(DAY, F.lit(19990101))
    assert px.within_frame(overwritten, *frame).count() == 1
    assert "PartitionFilters: [isnotnull(placed_day" in plan(px.within_frame(log, *frame))


def test_another_table_is_no_clean_log(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError, match="no clean log"):
        px.read_log(spark, str(tmp_path / "t"))


def sample(spark):
    rows = [(i % 5, i * 613 % 86400, "#000000", i % 3, i % 4) for i in range(300)]
    return make_log(spark, rows + [(1, None, "#FFFFFF", 0, 0)])


@pytest.mark.parametrize("folders, column", [("hour", HOUR), ("day", DAY), (None, None)])
def test_log_survives_writing(spark, tmp_path, folders, column):
    path = str(tmp_path / "log")
    px.write_log(sample(spark), path, folders, zstd_level=5)
    back = px.read_log(spark, path)
    assert rows_of(back, *CLEAN.fieldNames()) == rows_of(sample(spark))
    assert set(back.columns) - set(CLEAN.fieldNames()) == ({column} if column else set())
    with pytest.raises(Exception, match="(?i)exists"):
        px.write_log(sample(spark), path)


def test_clustered_log_is_written_again_from_itself(spark, tmp_path):
    first, second = str(tmp_path / "one"), str(tmp_path / "two")
    px.write_log(sample(spark), first)
    px.write_log(px.read_log(spark, first), second, folders=None)
    again = px.read_log(spark, second)
    assert rows_of(again) == rows_of(sample(spark))


def test_frames_read_only_their_hours(spark, tmp_path):
    path = str(tmp_path / "log")
    px.write_log(sample(spark), path)
    log = px.read_log(spark, path)
    frame = "2022-04-01 13", "2022-04-01 15"
    for inclusive in (False, True):
        inside = px.within_frame(log, *frame, inclusive)
        plain = px.within_frame(sample(spark), *frame, inclusive)
        assert rows_of(inside, *CLEAN.fieldNames()) == rows_of(plain)
        hours = inside.select(HOUR).distinct().collect()
        assert {h[0] for h in hours} <= {2022040113, 2022040114, 2022040115}
    files = px.within_frame(log, *frame).select(F.input_file_name()).distinct().count()
    assert 0 < files < log.select(F.input_file_name()).distinct().count()
    assert "PartitionFilters: [isnotnull(placed_hour" in plan(px.within_frame(log, *frame))


def test_a_hot_hour_is_written_by_several_tasks(spark, tmp_path):
    """Most rows in one hour, in one copy: AQE must split it and lose none."""
    settings = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    log = spark.sql(
        """select timestamp_ntz'2022-04-01 12:00:00' + make_dt_interval(0, if(id % 3 < 2, 0, id % 24)) as timestamp,
                  7L as user_id_hashed, '#000000' as pixel_color, 1 as x, 2 as y
           from range(0, 60000, 1, 8)"""
    )
    source, path = str(tmp_path / "plain"), str(tmp_path / "log")
    log.write.parquet(source)
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        px.write_log(px.read_log(spark, source), path)
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert px.read_log(spark, path).count() == 60000
    assert len(list((tmp_path / "log" / "placed_hour=2022040112").glob("*.parquet"))) > 1


@pytest.mark.parametrize("folders", ["hour", "day"])
def test_operators_agree_on_clustered_and_plain_log(spark, tmp_path, folders):
    path = str(tmp_path / "log")
    px.write_log(sample(spark), path, folders)
    log, plain = px.read_log(spark, path), sample(spark)
    frame = "2022-04-01 13", "2022-04-01 19"
    for operator in (
        lambda d: px.timeframe_summary(d, frame[0]),
        lambda d: px.rank_colors_by_distinct_users(d, *frame),
        lambda d: px.count_first_time_users(d, *frame),
        lambda d: px.placement_percentiles(d, *frame),
        lambda d: px.average_session_length(d, *frame),
        lambda d: px.canvas_region(d, 1, 1, 1, *frame),
    ):
        assert rows_of(operator(log)) == rows_of(operator(plain))


def test_hour_key_does_not_depend_on_the_session_zone(spark, tmp_path):
    log = spark.sql(
        "select timestamp_ntz'2022-03-13 02:30:00' as timestamp, 1L as user_id_hashed, "
        "'#000000' as pixel_color, 1 as x, 2 as y"
    )
    px.write_log(log, str(tmp_path / "log"))
    back = px.read_log(spark, str(tmp_path / "log"))
    assert back.first()[HOUR] == 2022031302
    assert px.within_frame(back, "2022-03-13 02", "2022-03-13 03").count() == 1


def test_fresh_paths_differ_and_use_the_shared_folder(spark):
    one, two = fresh_path(spark, "t"), fresh_path(spark, "t")
    assert one != two
    folder = spark.conf.get("spark.checkpoint.dir", None)
    assert folder is None or one.startswith(folder.rstrip("/"))


def test_tables_go_to_the_shared_folder_and_are_removed(spark):
    folder = shared_folder(spark)
    assert folder == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    kept = stored(spark.range(5), "removed")
    assert kept.count() == 5 and list(Path(folder).glob("removed-*"))
    drop_all(spark)
    assert not list(Path(folder).glob("removed-*"))


def test_checked_ingest_puts_every_line_in_one_result(spark, tmp_path):
    head = "timestamp,user_id,pixel_color,coordinate\n"
    good = '2022-04-01 12:00:00 UTC,a,#FFFFFF,"1,2"'
    bad = {
        "columns": ["2022-04-01 12:00:00 UTC,a", good + ",more", good[:-1], good.replace("#", '"#')],
        "timestamp": ['bad,a,#FFFFFF,"1,2"', ',a,#FFFFFF,"1,2"'],
        "coordinate": ['2022-04-01 12:00:00 UTC,a,#FFFFFF,"1,two"', "2022-04-01 12:00:00 UTC,a,#FFFFFF,"],
    }
    lines = [good, good, '2022-04-01 12:00:00 UTC,,,"3,4,5,6"', *(line for each in bad.values() for line in each)]
    (tmp_path / "a.csv").write_text(head + "\n".join(lines) + "\n\n")
    (tmp_path / "b.csv").write_text(head + good + "\n")
    (tmp_path / "c.csv").write_text(head)
    got = px.ingest_checked(spark, str(tmp_path))
    assert got.accepted.schema.simpleString() == CLEAN.simpleString()
    assert rows_of(got.accepted, "pixel_color", "x", "y") == [("#FFFFFF", 1, 2)] * 3 + [(None, 3, 4)]
    assert got.accepted.count() + got.rejected.count() == len(lines) + 1
    rejected = sorted((r.reason, r.line) for r in got.rejected.collect())
    assert rejected == sorted((reason, line) for reason, each in bad.items() for line in each)
    assert {r.file.rsplit("/", 1)[1] for r in got.rejected.collect()} == {"a.csv"}
    assert plan(px.checked_csv(spark, str(tmp_path))).count("FileScan text") == 1
    assert px.checked_csv(spark, str(tmp_path)).select("pixel_color").where("reason is null").count() == 4
    clean = px.ingest_csv(spark, str(tmp_path / "b.csv"))
    assert px.ingest_checked(spark, str(tmp_path / "b.csv")).accepted.collect() == clean.collect()
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.csv").write_text("timestamp,user_id\n")
    with pytest.raises(ValueError, match="pixel_color"):
        px.checked_csv(spark, str(tmp_path / "d"))
    (tmp_path / "d" / "x.csv").write_text(head + good + "\n")
    (tmp_path / "d" / "y.csv").write_text("user_id,timestamp,pixel_color,coordinate\n")
    with pytest.raises(Exception, match="other order of columns"):
        px.checked_csv(spark, str(tmp_path / "d")).collect()
