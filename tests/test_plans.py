"""What the plans must look like to hold up at scale."""

import re

import pytest

import pixeltide as px
from helpers import final_plan, make_log, plan
from pixeltide.sources.schema import CLEAN
from workload.queries import QUERIES

START, END = "2022-04-01 12", "2022-04-01 18"


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "log")
    rows = [(i % 5, i * 60, "#000000", i % 3, i % 4) for i in range(300)]
    px.write_log(make_log(spark, rows), path, folders=None)
    return px.read_log(spark, path)


def exchanges(text):
    return len(re.findall(r"(?<!Broadcast)\bExchange ", text))


def windows_over_everything(text):
    """What feeds each window that has all rows in one task."""
    found = re.findall(r"Window \[[^\n]*\n[^\n]*Sort [^\n]*\n[^\n]*Exchange SinglePartition[^\n]*\n([^\n]*)", text)
    return [re.sub(r"^[\s:+-]*(?:\*\(\d+\) )?", "", line) for line in found]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_no_cross_join_no_row_window_over_everything(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    for node in ("Python", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin", "Scan ExistingRDD"):
        assert node not in text, node
    for below in windows_over_everything(text):
        if name.startswith("sliding_frame"):  # the borders of the frames
            assert below.startswith("HashAggregate(keys=[begins"), below
            continue
        # Only the histogram of the colour ranking: one row per (users, prefix).
        assert name in ("rank_colors", "frame_report")
        assert below.startswith("HashAggregate(keys=[distinct_users") and "prefix" in below, below


def test_the_window_check_sees_a_window(log):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    bad = log.select(F.row_number().over(Window.orderBy("timestamp")))
    assert len(windows_over_everything(plan(bad))) == 1


def scans(text):
    """File scans that run: the last plan, without what is reused."""
    final = text[text.index("== Final Plan ==") : text.index("== Initial Plan ==")] if "== Initial" in text else text
    return len(re.findall("FileScan", final))


def test_costly_queries_read_the_log_no_more_than_needed(spark, sf_dir):
    for name, most in (("frame_report", 2), ("session_flags", 1), ("timeframe_summary", 1), ("session_assignments", 2)):
        text = final_plan(QUERIES[name](spark, sf_dir))
        assert scans(text) == most, name


def test_a_text_timestamp_is_parsed_once_in_the_filter(spark, sf_dir):
    text = plan(QUERIES["timeframe_summary_csv"](spark, sf_dir))
    condition = re.search(r"Filter (.*)", text).group(1)
    assert len(re.findall("cast", condition.replace("try_cast", "cast"))) == 1, condition


def test_colors_are_numbered_in_groups(spark):
    """Many codes with equal counts: their rank is that of one sort, but no task numbers them all."""
    rows = [(u, 1, f"#{u * 37 % 9000:06d}", 0, 0) for u in range(300)] + [(u, 1, "#000000", 0, 0) for u in range(5)]
    log = make_log(spark, rows + [(7, 2, None, 0, 0)])
    got = px.rank_colors_by_distinct_users(log, "2022-04-01 11", "2022-04-01 13").collect()
    wanted = sorted(got, key=lambda r: (-r.distinct_users, r.pixel_color or ""))
    assert [r.rank for r in wanted] == list(range(1, len(got) + 1))


def test_tile_order_reads_few_rows_of_a_region(spark, tmp_path):
    log = spark.sql(
        """select timestamp_ntz'2022-04-01 12:00:00' + make_dt_interval(0, 0, 0, id % 3000) as timestamp,
                  id % 977 as user_id_hashed, '#000000' as pixel_color,
                  cast(id * 7919 % 1009 as int) as x, cast(id * 104729 % 1013 as int) as y
           from range(0, 400000, 1, 4)"""
    )
    read = {}
    for order in ("tile", "time"):
        path = str(tmp_path / order)
        px.write_log(log, path, "day", order=order)
        region = px.read_log(spark, path).filter(px.in_box(400, 500, 20))
        assert region.count() == log.filter(px.in_box(400, 500, 20)).count()
        region.collect()
        scan = region._jdf.queryExecution().executedPlan()
        while scan.children().size():
            scan = scan.children().head()
        scan = scan.executedPlan() if "AdaptiveSparkPlan" in scan.nodeName() else scan
        while scan.children().size():
            scan = scan.children().head()
        read[order] = scan.metrics().apply("numOutputRows").value()
    assert 0 < read["tile"] < read["time"] / 4, read


def test_only_used_columns_are_read(log):
    text = plan(px.mode_in_frame(log, "pixel_color", START, END))
    assert "ReadSchema: struct<timestamp:timestamp_ntz,pixel_color:string>" in text
    assert "ReadSchema: struct<user_id_hashed:bigint>" in plan(px.top_users(log, 3))


def test_filters_reach_the_scan(log):
    text = plan(px.canvas_region(log, 10, 10, 5, START, END))
    assert "GreaterThanOrEqual(x,5)" in text and "LessThanOrEqual(y,15)" in text
    assert "In(user_id_hashed, [3,4])" in plan(px.user_positions(log, [3, 4]))


def test_summary_is_one_scan_and_one_shuffle_of_tallies(log):
    text = plan(px.timeframe_summary(log, START))
    assert text.count("FileScan") == 1
    assert exchanges(text) == 2  # by key, then one candidate per task
    assert "Join" not in text


def test_top_k_does_not_sort_everything(log):
    for df in (px.top_users(log, 5), px.top_pixels(log, 5), px.mode_coordinate_in_frame(log, START, END)):
        assert "TakeOrderedAndProject" in plan(df)


def test_sessions_are_folded_before_the_first_shuffle(log):
    text = plan(px.sessionize(log))
    assert exchanges(text) == 2
    assert "partial_count" in text
    # The ordered step works on (user, window) rows: the scan is below an aggregate.
    assert text.index("Window") < text.index("HashAggregate", text.index("Window")) < text.index("FileScan")


def test_canvas_is_hashed_before_it_is_sorted(log):
    text = plan(px.final_cells(log))
    scan_side = text[text.rindex("Exchange") :]
    assert "HashAggregate" in scan_side and "SortAggregate" not in scan_side


def test_limits_are_broadcast_by_size_and_unknown_sizes_are_not(spark, log):
    assert "BroadcastHashJoin" in plan(px.user_positions(log, px.top_users(log, 10)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64")
    try:
        assert "SortMergeJoin" in plan(px.user_positions(log, px.top_users(log, 100000)))
        assert "SortMergeJoin" in plan(px.at_pixels(log, px.top_pixels(log, 100000)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_hot_user_is_split_in_the_assignment_join(spark, tmp_path):
    """One user and one window with most rows: the join must run in skew splits."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    path = str(tmp_path / "log")
    spark.sql(
        """select timestamp_ntz'2022-04-01 12:00:00' + make_dt_interval(0, 0, 0, id % 800) as timestamp,
                  if(id % 3 < 2, 7L, id) as user_id_hashed, '#000000' as pixel_color,
                  cast(id as int) as x, cast(id * 7 % 1000 as int) as y
           from range(0, 60000, 1, 8)"""
    ).select(*CLEAN.fieldNames()).write.parquet(path)
    log = px.read_log(spark, path)
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        assigned = px.session_assignments(log)
        assert "SortMergeJoin(skew=true)" in final_plan(assigned)
        assert assigned.count() == 60000
        assert {r.session_id for r in assigned.select("session_id").distinct().collect()} == {1}
    finally:
        for key in settings:
            spark.conf.unset(key)
