"""The four audience answers of one frame."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixeltide.functions.time import Moment
from pixeltide.operators.audience import PERCENTAGES, count_first_time_users, percentiles_of, ranked_colors
from pixeltide.operators.filters import within_frame
from pixeltide.operators.sessions import GAP_SECONDS, average_of, session_slot, sessions_of


class FrameReport(NamedTuple):
    """One DataFrame per answer."""

    colors: DataFrame
    average_session: DataFrame
    percentiles: DataFrame
    first_time_users: DataFrame

    def as_table(self) -> DataFrame:
        """All answers as ``(section, position, label, value)`` rows of one plan."""

        def rows(df: DataFrame, section: str, position: str, label: str, value: str) -> DataFrame:
            return df.selectExpr(
                f"'{section}' as section", f"cast({position} as int) as position",
                f"cast({label} as string) as label", f"cast({value} as double) as value",
            )

        parts = (
            rows(self.colors, "color_users", "rank", "color", "distinct_users"),
            rows(self.average_session, "average_session_seconds", "1", "null", "avg_session_seconds"),
            rows(self.percentiles, "placement_percentile", "round(percentile * 100)", "null", "placements"),
            rows(self.first_time_users, "first_time_users", "1", "null", "first_time_users"),
        )
        return reduce(DataFrame.union, parts)


def frame_report(
    log: DataFrame,
    start: Moment,
    end: Moment,
    gap_seconds: int = GAP_SECONDS,
) -> FrameReport:
    """Colours by users, average session, percentiles and first-time users of the frame.

    The frame is folded once, to one row per user, session window and colour;
    colours, sessions and percentiles all follow from that table, so a plan that
    needs them all (``as_table``) reads the log twice: once for the frame, once
    for the history of first-time users. Nothing is cached: the answers share
    the shuffle of the folded rows. That needs the same columns in each of
    them, hence the filter, which keeps all and lets none be pruned.
    """
    inside = within_frame(log, start, end, end_inclusive=True).withColumn("slot", session_slot(gap_seconds))
    folded = inside.groupBy("user_id_hashed", "slot", "pixel_color").agg(
        F.expr("min(timestamp) as first_placed"), F.expr("max(timestamp) as last_placed"), F.expr("count(*) as placements")
    )
    folded = folded.filter("placements > 0 and first_placed <= last_placed")
    per_color = folded.groupBy("pixel_color").agg(F.expr("count(distinct user_id_hashed) as distinct_users"))
    per_user = folded.groupBy("user_id_hashed").agg(F.expr("sum(placements) as n"))
    slots = folded.groupBy("user_id_hashed", "slot").agg(
        F.expr("min(first_placed) as first_placed"), F.expr("max(last_placed) as last_placed"), F.expr("sum(placements) as placements")
    )
    return FrameReport(
        ranked_colors(per_color),
        average_of(sessions_of(slots, gap_seconds)),
        percentiles_of(per_user, PERCENTAGES),
        count_first_time_users(log, start, end),
    )
