"""A pixel log made from every row of the driver's ``events`` table.

The expressions are valid in both Spark SQL and DuckDB, but for the name of the
zone-less timestamp type. ``#123456`` is not on the palette; the two signup
colours share one name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Declared, so that no job reads footers to find it.
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string"

# Rows exactly at the frame's end, peers of one user at one instant, and NULL
# users, colours and times: every 7th hundred of events is bent to one of them.
END = "2024-01-20 18:00:00"
TIME = f"""case when event_id % 700 = 11 then cast('{END}' as timestamp_ntz)
            when event_id % 700 = 12 then null
            when event_id % 700 in (13, 14, 15) then cast('2024-01-10 12:00:00' as timestamp_ntz) else ts end"""
USER = "case when event_id % 700 between 16 and 20 then null when event_id % 700 in (13, 14, 15) then 3 else user_id end"

PAINTED = [
    """case when event_id % 700 = 21 then null else case event_type when 'click' then '#FFFFFF' when 'view' then '#000000' when 'purchase' then '#FF4500'
            when 'signup' then case when event_id % 3 = 0 then '#00A368' else '#00756F' end
            else case when event_id % 5 = 0 then '#123456' else '#E4ABFF' end end end as pixel_color""",
    "cast((event_id * 7 + user_id) % 23 as int) as x",
    "cast((event_id * 3 + user_id * user_id) % 17 as int) as y",
]
CLEAN = [f"{TIME} as timestamp", f"{USER} as user_id_hashed", *PAINTED]

# A fraction is absent on every fourth row and has one digit on every 31st;
# every 97th timestamp is junk, and some are a year, a date or have an offset,
# which is junk too; every tenth coordinate has four parts.
RAW = [
    """case when event_id % 97 = 0 then 'bad'
            when event_id % 97 = 1 then '2022'
            when event_id % 97 = 2 then '2024-01-10'
            when event_id % 97 = 3 then date_format(ts, 'yyyy-MM-dd HH:mm:ss') || '+02:00'
            when event_id % 31 = 0 then date_format(ts, 'yyyy-MM-dd HH:mm:ss.S') || ' UTC'
            when event_id % 4 = 0 then date_format(ts, 'yyyy-MM-dd HH:mm:ss') || ' UTC'
            else date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSS') || ' UTC' end as timestamp""",
    "cast(user_id as string) as user_id",
    "pixel_color",
    """case when event_id % 10 = 0 then concat_ws(',', x, y, x + 1, y + 1)
            else concat_ws(',', x, y) end as coordinate""",
]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


def placements(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The clean log, and ``more`` columns of the events."""
    return _events(spark, sf_dir).selectExpr(*CLEAN, *more)


def raw_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw log, all text."""
    return _events(spark, sf_dir).selectExpr("*", *PAINTED).selectExpr(*RAW)
