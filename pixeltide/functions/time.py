"""Time expressions on zone-less timestamps.

The log keeps the UTC wall clock as TIMESTAMP_NTZ, so no result depends on the
zone of the session.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

Moment = datetime | str

HOUR_FORMAT = "%Y-%m-%d %H"


class Frame(NamedTuple):
    """A named stretch of time."""

    name: str
    start: datetime
    end: datetime


def as_moment(value: Moment) -> datetime:
    """A zone-less UTC datetime from a datetime, ``YYYY-MM-DD HH`` or ISO text."""
    if isinstance(value, str):
        try:
            value = datetime.strptime(value, HOUR_FORMAT)
        except ValueError:
            value = datetime.fromisoformat(value)
    if value.tzinfo is not None:
        value = value.astimezone(timezone.utc).replace(tzinfo=None)
    return value


def as_range(start: Moment, end: Moment) -> tuple[datetime, datetime]:
    """Both ends as datetimes; the end must lie after the start."""
    first, last = as_moment(start), as_moment(end)
    if last <= first:
        raise ValueError(f"end must be after start: {first} .. {last}")
    return first, last


def hour_frames(start: Moment, hours: tuple[int, ...] = (1, 3, 6)) -> list[Frame]:
    """Frames that share ``start`` and last the given numbers of hours."""
    if not hours or any(h <= 0 for h in hours) or len(set(hours)) != len(hours):
        raise ValueError(f"hours must be distinct and positive: {hours}")
    first = as_moment(start)
    return [Frame(f"{h}-Hour Timeframe", first, first + timedelta(hours=h)) for h in hours]


def last_inside(end: datetime, end_inclusive: bool) -> datetime:
    """The last moment before (or at) the end; timestamps have microseconds."""
    return end if end_inclusive else end - timedelta(microseconds=1)


def moment(value: Moment) -> Column:
    """A TIMESTAMP_NTZ literal; a bare ``F.lit(datetime)`` would carry the session zone."""
    return F.lit(as_moment(value).isoformat(sep=" ")).cast("timestamp_ntz")


def in_frame(column: Column | str, start: Moment, end: Moment, end_inclusive: bool = False) -> Column:
    """True inside the frame: BETWEEN its start and the last moment inside."""
    first, last = as_range(start, end)
    ts = F.col(column) if isinstance(column, str) else column
    return ts.between(moment(first), moment(last_inside(last, end_inclusive)))


def in_frame_once(
    column: Column | str, start: Moment, end: Moment, end_inclusive: bool = False
) -> Column:
    """``in_frame`` as one comparison that mentions the time once; false for NULL.

    For a time that is parsed from text, which a plain range would parse again
    for each bound, and again to see that it is not NULL. Twice the distance
    from the start, less the length, is no more than the length on either side
    of zero: exact for any number of microseconds. It cannot be pushed to a
    Parquet scan, so stored times keep the plain range.
    """
    first, last = as_range(start, end)
    length = last_inside(last, end_inclusive) - first
    ts = F.col(column) if isinstance(column, str) else column
    inside = F.abs((ts - moment(first)) * 2 - F.lit(length)) <= F.lit(length)
    return F.coalesce(inside, F.lit(False))


def day_key(column: Column | str) -> Column:
    """The day of a timestamp as an int such as 20220401."""
    ts = F.col(column) if isinstance(column, str) else column
    return F.year(ts) * 10000 + F.month(ts) * 100 + F.dayofmonth(ts)


def hour_key(column: Column | str) -> Column:
    """The hour of a timestamp as an int such as 2022040112."""
    ts = F.col(column) if isinstance(column, str) else column
    return day_key(ts) * 100 + F.hour(ts)


# The accepted text forms of a timestamp, without and with offsets.
_PLAIN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]{1,6})?"
UTC_FORM = _PLAIN + " UTC$"
OFFSET_FORM = _PLAIN + " ?(UTC|Z|[+-][0-9]{2}:?[0-9]{2})$"


def parse_timestamp(text: Column | str, strict: bool = False, offsets: bool = False) -> Column:
    """Text such as ``2022-04-01 12:00:00.123 UTC`` as TIMESTAMP_NTZ.

    The fraction is optional and has 1 to 6 digits. Any other shape (a bare
    date, a year, no zone) becomes NULL, or an error when ``strict``. With ``offsets``,
    ``Z`` or an offset such as ``+02:00`` may stand in place of UTC and is
    converted to UTC; without, such text is junk.
    """
    column = F.col(text) if isinstance(text, str) else text
    if not offsets:
        shaped = F.when(column.rlike(UTC_FORM), F.regexp_replace(column, " UTC$", ""))
        if strict:  # text of another shape is left as it is, which no cast accepts
            return F.when(column.isNotNull(), F.coalesce(shaped, F.concat(F.lit("not UTC: "), column))).cast("timestamp_ntz")
        return shaped.try_cast("timestamp_ntz")
    shaped = F.when(column.rlike(OFFSET_FORM), F.substring(column, 1, 19))
    fraction = F.rpad(F.regexp_extract(column, r"[.]([0-9]{1,6})", 1), 6, "0").try_cast("int")
    sign = F.when(F.regexp_extract(column, "([+-])[0-9]{2}:?[0-9]{2}$", 1) == "-", -1).otherwise(1)
    hours, minutes = (
        F.coalesce(F.regexp_extract(column, "[+-]([0-9]{2}):?([0-9]{2})$", k).try_cast("int"), F.lit(0)) * sign
        for k in (1, 2)
    )
    if strict:
        shaped = F.when(column.isNotNull(), F.coalesce(shaped, F.concat(F.lit("no timestamp: "), column)))
    whole = shaped.cast("timestamp_ntz") if strict else shaped.try_cast("timestamp_ntz")
    zone = F.regexp_extract(column, "([+-][0-9]{2}:?[0-9]{2})$", 1) != ""
    moved = F.when(zone & shaped.isNotNull(), F.make_dt_interval(hours=hours, mins=minutes)).otherwise(F.make_dt_interval())
    return whole - moved + F.make_dt_interval(secs=(fraction / F.lit(1000000)).cast("decimal(18,6)"))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Seconds from ``start`` to ``end`` as a double, fractions kept."""
    first = F.col(start) if isinstance(start, str) else start
    last = F.col(end) if isinstance(end, str) else end
    return (last - first).cast("interval second").cast("decimal(18,6)").cast("double")
