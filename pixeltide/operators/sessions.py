"""User sessions: placements no more than ``gap_seconds`` apart.

All placements of a user that fall into one tumbling window as wide as the gap
are less than a gap apart, so they belong to one session. The log is therefore
first folded into one row per (user, window), which Spark combines before the
shuffle, and only these rows are put in order per user. However many placements
a user has, the ordered step sees at most (time span / gap) rows of that user;
a gap of a few seconds over a long time weakens that bound.

A NULL user is a user like any other in all operators here. Placements without
time are in no session.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixeltide.functions.time import Moment
from pixeltide.operators.filters import within_frame

GAP_SECONDS = 900


def _whole(gap_seconds: int) -> int:
    if isinstance(gap_seconds, bool) or gap_seconds != int(gap_seconds) or gap_seconds <= 0:
        raise ValueError(f"the gap must be a whole number of seconds above 0: {gap_seconds}")
    return int(gap_seconds)


def session_slot(gap_seconds: int) -> Column:
    """Start of the tumbling window, as wide as the gap, that a placement lies in."""
    return F.window("timestamp", f"{_whole(gap_seconds)} seconds")["start"]


def _same_user_and(log: DataFrame, other: DataFrame, *keys: str) -> Column:
    """Join condition in which a NULL user equals a NULL user; Spark hashes and sorts by it as by plain keys."""
    return reduce(and_, (log[key].eqNullSafe(other[f"{key}_"]) for key in ("user_id_hashed", *keys)))


def folded(log: DataFrame, gap_seconds: int) -> DataFrame:
    """One row per user and window: first, last and count."""
    slots = log.select("user_id_hashed", "timestamp", session_slot(gap_seconds).alias("slot"))
    return slots.groupBy("user_id_hashed", "slot").agg(
        F.expr("min(timestamp) as first_placed"), F.expr("max(timestamp) as last_placed"), F.expr("count(*) as placements")
    )


# Told as SQL text: each Python column is several calls to the JVM, which add up in plans of many operators.


def _numbered(slots: DataFrame, gap_seconds: int) -> DataFrame:
    """Folded rows with the session each is part of."""
    by_user = "over (partition by user_id_hashed order by first_placed)"
    pause = f"first_placed - lag(last_placed) {by_user}"
    goes_on = f"coalesce({pause} <= make_dt_interval(0, 0, 0, {_whole(gap_seconds)}), false)"
    flagged = slots.selectExpr("*", f"case when {goes_on} then 0 else 1 end as new_session")
    return flagged.selectExpr("*", f"sum(new_session) {by_user} as session_id")


def sessions_of(slots: DataFrame, gap_seconds: int) -> DataFrame:
    """One row per session of folded rows (user, slot, first_placed, last_placed, placements)."""
    sessions = _numbered(slots, gap_seconds).groupBy("user_id_hashed", "session_id").agg(
        F.expr("min(first_placed) as session_start"),
        F.expr("max(last_placed) as session_end"),
        F.expr("sum(placements) as placements"),
    )
    length = "cast(session_end - session_start as interval second)"
    return sessions.selectExpr("*", f"cast(cast({length} as decimal(18, 6)) as double) as session_seconds")


def average_of(sessions: DataFrame) -> DataFrame:
    """Average seconds and number of the sessions with more than one placement."""
    return sessions.filter("placements > 1").agg(
        F.expr("avg(session_seconds) as avg_session_seconds"), F.expr("count(*) as sessions")
    )


def sessionize(log: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """One row per session, numbered from 1 per user.

    A pause of exactly the gap continues the session; a longer one ends it.
    """
    return sessions_of(folded(log, gap_seconds), gap_seconds)


def session_flags(log: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """One row per user and instant: how many placements, and does a session start there.

    Placements of a user at one instant are peers, of which one starts the
    session; they are folded into ``placements``. The windows are folded from
    these rows, so the log is read and shuffled once; the shuffle's result
    serves both sides of the join.
    """
    instants = (
        log.filter(F.col("timestamp").isNotNull())
        .groupBy("user_id_hashed", "timestamp")
        .agg(F.count("*").alias("placements"))
    )
    slots = (
        instants.withColumn("slot", session_slot(gap_seconds))
        .groupBy("user_id_hashed", "slot")
        .agg(
            F.min("timestamp").alias("first_placed"),
            F.max("timestamp").alias("last_placed"),
            F.sum("placements").alias("placements"),
        )
    )
    starts = (
        _numbered(slots, gap_seconds)
        .filter("new_session = 1 and placements > 0")
        .select(F.col("user_id_hashed").alias("user_id_hashed_"), F.col("first_placed").alias("timestamp_"), "new_session")
    )
    return instants.join(starts, _same_user_and(instants, starts, "timestamp"), "left").select(
        "user_id_hashed", "timestamp", "placements", F.coalesce("new_session", F.lit(0)).alias("new_session")
    )


def session_assignments(log: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """Every placement that has a time, with the number of its session.

    A join on (user, window): a busy user is spread over that user's
    windows, and Spark splits a window that is still too big (AQE skew join).
    That takes a second scan of the log.
    """
    slots = _numbered(folded(log, gap_seconds), gap_seconds).select(
        F.col("user_id_hashed").alias("user_id_hashed_"), F.col("slot").alias("slot_"), "session_id"
    )
    dealt = log.withColumn("slot", session_slot(gap_seconds))
    return dealt.join(slots, _same_user_and(dealt, slots, "slot")).select(
        *(dealt[c] for c in log.columns), "session_id"
    )


def session_durations(log: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """The sessions of more than one placement."""
    return sessionize(log, gap_seconds).filter("placements > 1")


def average_session_length(
    log: DataFrame,
    start: Moment,
    end: Moment,
    gap_seconds: int = GAP_SECONDS,
    end_inclusive: bool = True,
) -> DataFrame:
    """Average seconds of the sessions with more than one placement, NULL if there is none.

    The frame is cut first: a session that crosses its border counts with the
    part inside.
    """
    inside = within_frame(log, start, end, end_inclusive)
    return average_of(sessionize(inside, gap_seconds))
