"""Answers over a growing history without a scan of all of it.

First placements of users and the canvas have one row per user or cell, are
folded from the rows of a load, and merge with any other state of their kind,
so the order and size of the loads never change the result. Sessions go on
from one load to the next and are loaded in the order of time.
"""

from __future__ import annotations

from datetime import datetime, time, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixeltide.functions.time import Moment, as_moment, as_range, moment, seconds_between
from pixeltide.operators.filters import in_box, until, within_frame
from pixeltide.operators.sessions import GAP_SECONDS, folded, sessions_of
from pixeltide.sources.kept_table import KeptTable

# First placements of users


def first_placements(log: DataFrame) -> DataFrame:
    """(user_id_hashed, first_placement): one row per user; NULL is a user, placements without time do not count."""
    return (
        log.where("timestamp is not null").groupBy("user_id_hashed").agg(F.min("timestamp").alias("first_placement"))
    )


def _earliest(states: DataFrame) -> DataFrame:
    return states.groupBy("user_id_hashed").agg(F.min("first_placement").alias("first_placement"))


def kept_first_placements(spark: SparkSession, path: str) -> KeptTable:
    """The kept table of first placements; ``load(name, rows)`` merges the rows of a new folder or file."""
    return KeptTable(spark, path, first_placements, _earliest)


def count_first_time_users_of(firsts: DataFrame, start: Moment, end: Moment, end_inclusive: bool = True) -> DataFrame:
    """``count_first_time_users`` from first placements: reads one row per user, whatever the history."""
    first, last = as_range(start, end)
    return within_frame(firsts.withColumnRenamed("first_placement", "timestamp"), first, last, end_inclusive).agg(
        F.count("*").alias("first_time_users")
    )


# The canvas


def painted_cells(log: DataFrame) -> DataFrame:
    """(x, y, timestamp, pixel_color): the last placement of every cell, the larger code at one instant.

    Time is taken per (cell, colour) first, which is combined before the
    shuffle. Placements without time or colour win no cell.
    """
    whole = log.where("timestamp is not null and pixel_color is not null")
    per_color = whole.groupBy("x", "y", "pixel_color").agg(F.max("timestamp").alias("timestamp"))
    last = F.max(F.struct("timestamp", "pixel_color")).alias("last")
    return per_color.groupBy("x", "y").agg(last).select("x", "y", "last.timestamp", "last.pixel_color")


class CanvasHistory:
    """The canvas at any moment: snapshots at the ends of days, and replay of what came after.

    ``log`` is a log as ``read_log`` gives it; in one with day or hour folders
    a replay reads only the folders after the snapshot. A snapshot has one row
    per painted cell and is made of the one before it and the days between.
    Placements that join the log later, but lie before a snapshot, are in none:
    begin new snapshots for such a log.
    """

    def __init__(self, log: DataFrame, path: str):
        self.log, self.path, self.spark = log, path.rstrip("/"), log.sparkSession

    def _snapshots(self) -> KeptTable:
        return KeptTable(self.spark, self.path, painted_cells, painted_cells)

    def days(self) -> list[datetime]:
        """Moments of the snapshots, all placements before which are in them, oldest first."""
        return sorted(map(datetime.fromisoformat, self._snapshots().loads()))

    def snapshot(self, day: Moment) -> bool:
        """Keep the canvas as of the start of ``day`` (the end of the day before); days must be given in order."""
        border = datetime.combine(as_moment(day).date(), time())
        known = self.days()
        if known and border <= known[-1]:
            if border in known:
                return False
            raise ValueError(f"the snapshot of {known[-1]} is later than {border}")
        rows = within_frame(self.log, known[-1], border) if known else until(self.log, border, False)
        return self._snapshots().load(border.isoformat(), rows, keep=1 << 30)

    def at(self, when: Moment) -> DataFrame:
        """(x, y, pixel_color) as of ``when``, placements at that very moment left out.

        From the latest snapshot that is not after ``when``; without one, from the whole log until then.
        """
        border = as_moment(when)
        known = [d for d in self.days() if d <= border]
        if not known:
            return painted_cells(until(self.log, border, False)).select("x", "y", "pixel_color")
        table = self._snapshots()
        kept = table.read(table.versions()[len(known) - 1])
        if border > known[-1]:
            later = within_frame(self.log, known[-1], border)
            kept = painted_cells(kept.unionByName(later.select("x", "y", "timestamp", "pixel_color")))
        return kept.select("x", "y", "pixel_color")

    def region(self, when: Moment, cx: int, cy: int, radius: int = 50) -> DataFrame:
        """The painted cells around (cx, cy) as of ``when``."""
        return self.at(when).where(in_box(cx, cy, radius))


# Sessions


class SessionHistory:
    """Sessions of a log that arrives piece by piece, in the order of time.

    A load holds the placements from the border before it (any, for the first)
    to its own, its end left out; others are an error. What may go on after the border is kept as
    an open session (user, start, end, placements); what cannot is closed and
    written once. A load reads its own rows and the open sessions only.
    """

    def __init__(self, spark: SparkSession, path: str, gap_seconds: int = GAP_SECONDS):
        self.spark, self.path, self.gap = spark, path.rstrip("/"), gap_seconds
        self._open = KeptTable(spark, f"{self.path}/open", lambda rows: rows, lambda rows: rows)

    def borders(self) -> list[datetime]:
        return sorted(map(datetime.fromisoformat, self._open.loads()))

    def _closed(self, border: datetime) -> str:
        return f"{self.path}/closed/{border:%Y%m%d%H%M%S%f}"

    def load(self, border: Moment, rows: DataFrame) -> bool:
        """Add the placements until ``border``; False if that border was loaded before."""
        last, known = as_moment(border), self.borders()
        if last in known:
            return False
        if known and last < known[-1]:
            raise ValueError(f"the load until {known[-1]} is later than {last}")
        ts = F.col("timestamp")
        early = ts < moment(known[-1]) if known else F.lit(False)
        wrong = F.raise_error(F.concat(F.lit("outside the load: "), ts.cast("string"))).cast("timestamp_ntz")
        checked = rows.withColumn("timestamp", F.when((ts >= moment(last)) | early, wrong).otherwise(ts))
        slots = folded(checked.where("timestamp is not null"), self.gap)
        if known:
            before = self._open.read().select(
                "user_id_hashed", F.col("session_start").alias("slot"), F.col("session_start").alias("first_placed"),
                F.col("session_end").alias("last_placed"), "placements",
            )
            slots = slots.unionByName(before)
        found = sessions_of(slots, self.gap).drop("session_id", "session_seconds")
        ended = F.col("session_end") < moment(last - timedelta(seconds=self.gap))
        found.where(ended).write.mode("overwrite").parquet(self._closed(last))
        self._open.commit(last.isoformat(), found.where(~ended))
        return True

    def sessions(self) -> DataFrame:
        """(user_id_hashed, session_start, session_end, placements, session_seconds) of all loads, open sessions as far as they go."""
        paths = [self._closed(border) for border in self.borders()]
        rows = self._open.read()
        rows = rows.unionByName(self.spark.read.schema(rows.schema).parquet(*paths))
        return rows.withColumn("session_seconds", seconds_between("session_start", "session_end"))


def days_between(start: Moment, end: Moment) -> list[datetime]:
    """Midnights after ``start``, up to ``end``."""
    first, last = as_range(start, end)
    day = datetime.combine(first.date(), time()) + timedelta(days=1)
    found = []
    while day <= last:
        found.append(day)
        day += timedelta(days=1)
    return found
