"""DuckDB SQL for each query, over the same tables."""

from __future__ import annotations

from pixeltide.functions.color import PALETTE, UNKNOWN
from pixeltide.functions.time import as_moment, hour_frames
from workload.placements import CLEAN, PAINTED
from workload.queries import (
    CENTER_X,
    CENTER_Y,
    END,
    FIRST_END,
    FIRST_START,
    HEIGHT,
    HOURS,
    LONG_GAP,
    PIXELS,
    RADIUS,
    SESSION_BORDERS,
    SLIDE_END,
    SLIDE_HOURS,
    SLIDE_START,
    START,
    USERS,
    WIDTH,
)


def _ts(value) -> str:
    return f"timestamp '{as_moment(value)}'"


LOG = f"p as (select {', '.join(CLEAN)} from events)".replace("timestamp_ntz", "timestamp")
FRAMED = f"{LOG}, f as (select * from p where timestamp >= {_ts(START)} and timestamp <= {_ts(END)})"
HALF_OPEN = f"{LOG}, f as (select * from p where timestamp >= {_ts(START)} and timestamp < {_ts(END)})"
BOX = (
    f"x >= {CENTER_X - RADIUS} and x <= {CENTER_X + RADIUS} "
    f"and y >= {CENTER_Y - RADIUS} and y <= {CENTER_Y + RADIUS}"
)
NAMES = "names(pixel_color, name) as (values " + ", ".join(f"('{c}', '{n}')" for c, n in PALETTE.items()) + ")"
NAMED = f"coalesce(name, '{UNKNOWN}') as color"

# Tenths, milliseconds or whole seconds survive, by the rule that wrote the text.
RAW = f"""
r as (select event_id, user_id, pixel_color, x, y,
        case when event_id % 97 < 4 then null
             when event_id % 31 = 0 then date_trunc('second', ts) + to_milliseconds(100 * cast(tenth as int))
             when event_id % 4 = 0 then date_trunc('second', ts)
             else date_trunc('millisecond', ts) end as timestamp,
        case when event_id % 97 = 0 then 'bad'
             when event_id % 97 = 1 then '2022'
             when event_id % 97 = 2 then '2024-01-10'
             when event_id % 97 = 3 then strftime(ts, '%Y-%m-%d %H:%M:%S') || '+02:00'
             when event_id % 31 = 0 then strftime(ts, '%Y-%m-%d %H:%M:%S.') || tenth || ' UTC'
             when event_id % 4 = 0 then strftime(ts, '%Y-%m-%d %H:%M:%S') || ' UTC'
             else strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || ' UTC' end as text,
        case when event_id % 10 = 0 then x || ',' || y || ',' || (x + 1) || ',' || (y + 1)
             else x || ',' || y end as coordinate
      from (select event_id, user_id, ts, substr(strftime(ts, '%g'), 1, 1) as tenth, {', '.join(PAINTED)} from events))
"""


def _rgb(column: str) -> str:
    def digit(position: int) -> str:
        return f"(instr('0123456789ABCDEF', upper(substr({column}, {position}, 1))) - 1)"

    return ", ".join(
        f"cast({digit(p)} * 16 + {digit(p + 1)} as int) as {name}" for p, name in ((2, "r"), (4, "g"), (6, "b"))
    )


# By definition: a placement opens a session if its user has none in the 900 s
# before it, and a session's number is how many were opened so far.
SESSIONS = f"""
{FRAMED},
instants as (select user_id_hashed, timestamp, count(*) as placements from f group by all),
marked as (select *, 0 = count(*) over (partition by user_id_hashed order by timestamp
                                        range between interval 900 seconds preceding
                                              and interval 1 microsecond preceding) as opens from instants),
sessions as (select *, count(*) filter (where opens) over (partition by user_id_hashed order by timestamp)
                         as session_id from marked),
durations as (select user_id_hashed, session_id, min(timestamp) as session_start, max(timestamp) as session_end,
                     cast(sum(placements) as bigint) as placements,
                     extract(epoch from max(timestamp) - min(timestamp)) as session_seconds
              from sessions group by user_id_hashed, session_id having sum(placements) > 1)
"""


# The same definition over the whole log and with another gap; NULL users are one user.
LONG_SESSIONS = f"""
{LOG},
instants as (select user_id_hashed, timestamp, count(*) as placements from p
             where timestamp is not null and timestamp < {_ts(SESSION_BORDERS[-1])} group by all),
marked as (select *, 0 = count(*) over (partition by user_id_hashed order by timestamp
                                        range between interval {LONG_GAP} seconds preceding
                                              and interval 1 microsecond preceding) as opens from instants),
sessions as (select *, count(*) filter (where opens) over (partition by user_id_hashed order by timestamp)
                         as session_id from marked)
"""


def _mode(key: str, name: str) -> str:
    return f"""with {HALF_OPEN}
select {key} as {name}, count(*) as placements from f where {key} is not null group by {key} order by placements desc, {name} limit 1"""


def _frames() -> str:
    rows = ", ".join(
        f"('{f.name}', {h}, {_ts(f.start)}, {_ts(f.end)}, '{f.start} to {f.end}')"
        for f, h in zip(hour_frames(START, HOURS), HOURS)
    )
    return f"frames(name, hours, frame_start, frame_end, timeframe) as (values {rows})"


def _frame_tops(key: str, tag: str, log: str = "p") -> str:
    return f"""{tag} as (select * from (
  select name, k, n, row_number() over (partition by name order by n desc, k) as rn from (
    select name, {key} as k, count(*) as n
    from {log} join frames on timestamp >= frame_start and timestamp < frame_end group by name, {key})) where rn = 1)"""


COORDINATE = "x || ',' || y"
COLOR_TOPS, CELL_TOPS = _frame_tops("pixel_color", "c"), _frame_tops(COORDINATE, "q")
SUMMARY = """
select frames.name, hours, frame_start, frame_end, timeframe, c.k as most_color, c.n as color_placements,
       q.k as most_pixel, q.n as pixel_placements
from frames left join c on c.name = frames.name left join q on q.name = frames.name"""

SLIDING = f"""slid as (select t as frame_start, t + interval {SLIDE_HOURS} hours as frame_end
  from range({_ts(SLIDE_START)}, {_ts(SLIDE_END)}, interval 1 hour) as r(t))"""


def _slid_tops(key: str, tag: str) -> str:
    return f"""{tag} as (select * from (
  select frame_start, k, n, row_number() over (partition by frame_start order by n desc, k) as rn from (
    select frame_start, {key} as k, count(*) as n from p join slid on timestamp >= frame_start and timestamp < frame_end
    where {key} is not null group by all)) where rn = 1)"""


PER_USER = "per_user as (select count(*) as n from f group by user_id_hashed)"
PERCENTAGES = (0.5, 0.75, 0.9, 0.99)
PERCENTILES = " union all ".join(
    f"select cast({p} as double) as percentile, round(quantile_cont(n, {p}), 6) as placements, "
    f"cast(trunc(quantile_cont(n, {p})) as int) as whole_placements from per_user"
    for p in PERCENTAGES
)
RANKED = f"""ranked as (
  select cast(row_number() over (order by u desc, pixel_color nulls first) as int) as rank, pixel_color, {NAMED},
         u as distinct_users
  from (select pixel_color, count(distinct user_id_hashed) as u from f group by pixel_color)
       left join names using (pixel_color))"""
AVERAGE = "select round(avg(session_seconds), 6) as avg_session_seconds, count(*) as sessions from durations"
TOP_USERS = """t as (select user_id_hashed, count(*) as placements from p group by user_id_hashed
      order by placements desc, user_id_hashed limit {k})"""
TOP_PIXELS = "(select x, y, count(*) as placements from p group by x, y order by placements desc, x, y limit {k})"
PIXEL_LIST = ", ".join(str(pixel) for pixel in PIXELS)
# A placement without colour or time wins no cell.
PAINTS = "pixel_color is not null and timestamp is not null"
REGION = f"""{HALF_OPEN}, cells as (
  select x, y, pixel_color from (
    select x, y, pixel_color, row_number() over (partition by x, y order by timestamp desc, pixel_color desc) as rn
    from f where {BOX} and {PAINTS}) where rn = 1)"""
GRID = f"""grid as (select cast(a as int) as x, cast(b as int) as y
  from generate_series(0, {WIDTH - 1}) as u(a), generate_series(0, {HEIGHT - 1}) as v(b))"""


def _dense(background: str) -> str:
    return f"""filled as (select x, y, coalesce(pixel_color, '{background}') as pixel_color
  from grid left join cells using (x, y))
select x, y, x as dx, y as dy, pixel_color, {_rgb('pixel_color')} from filled"""


def _pixel_colors(condition: str) -> str:
    return f"""select x, y, cast(rn as int) as rank, pixel_color, {NAMED}, frequency from (
  select *, row_number() over (partition by x, y order by frequency desc, pixel_color) as rn from (
    select x, y, pixel_color, count(*) as frequency from p where {condition} group by x, y, pixel_color))
  left join names using (pixel_color)"""


ORACLE: dict[str, str] = {
    "csv_ingest": f"with {RAW} select timestamp, pixel_color, x, y from r",
    "csv_checked": f"with {RAW} select timestamp, pixel_color, x, y, if(timestamp is null, 'timestamp', null) as reason from r",
    "parquet_roundtrip": f"with {LOG} select * from p",
    "frame_of_clustered_log": f"with {HALF_OPEN} select * from f",
    "split_coordinates": f"with {RAW} select coordinate, x, y from r",
    "user_hash_cardinality": "select count(distinct user_id) as users from events",
    "parse_timestamps": f"with {RAW} select text, timestamp from r",
    "region_of_clustered_log": f"with {HALF_OPEN} select * from f where {BOX}",
    "filter_half_open": f"with {HALF_OPEN} select * from f",
    "filter_closed": f"with {FRAMED} select * from f",
    "filter_between": f"with {LOG} select * from p where timestamp between {_ts(START)} and {_ts(END)}",
    "filter_bbox": f"with {LOG} select * from p where {BOX}",
    "filter_tuple_in": f"with {LOG} select * from p where (x, y) in ({PIXEL_LIST})",
    "filter_isin": f"with {LOG} select x, y, user_id_hashed, pixel_color, timestamp from p "
    f"where user_id_hashed in ({', '.join(map(str, USERS))})",
    "session_flags": f"with {SESSIONS} select user_id_hashed, timestamp, placements, "
    "cast(opens as int) as new_session from marked",
    "session_assignments": f"with {SESSIONS} "
    "select f.*, session_id from f join sessions on f.user_id_hashed is not distinct from sessions.user_id_hashed "
    "and f.timestamp = sessions.timestamp",
    "session_durations": f"with {SESSIONS} select * from durations",
    "avg_session_length": f"with {SESSIONS} {AVERAGE}",
    "count_by_color": f"with {LOG} select pixel_color, count(*) as placements from p group by pixel_color",
    "count_by_pixel": f"with {LOG} select x, y, count(*) as placements from p group by x, y",
    "mode_color": _mode("pixel_color", "pixel_color"),
    "mode_coordinate": _mode(COORDINATE, "coordinate"),
    "timeframe_mode_color": f"""with {LOG}, {_frames()}, {COLOR_TOPS}
select name, hours, frame_start, frame_end, k as pixel_color, n as placements from frames left join c using (name)""",
    "timeframe_mode_coordinate": f"""with {LOG}, {_frames()}, {CELL_TOPS}
select name, hours, frame_start, frame_end, k as coordinate, n as placements from frames left join q using (name)""",
    "timeframe_summary": f"with {LOG}, {_frames()}, {COLOR_TOPS}, {CELL_TOPS} {SUMMARY}",
    "timeframe_summary_csv": f"with {RAW}, {_frames()}, {_frame_tops('pixel_color', 'c', 'r')}, "
    f"{_frame_tops('coordinate', 'q', 'r')} {SUMMARY}",
    "sliding_frame_modes": f"with {LOG}, {SLIDING}, {_slid_tops('pixel_color', 'c')} "
    "select frame_start, frame_end, k as pixel_color, n as placements from slid left join c using (frame_start)",
    "sliding_frame_summary": f"with {LOG}, {SLIDING}, {_slid_tops('pixel_color', 'c')}, {_slid_tops(COORDINATE, 'q')} "
    "select frame_start, frame_end, c.k as most_color, c.n as color_placements, q.k as most_pixel, q.n as pixel_placements "
    "from slid left join c using (frame_start) left join q using (frame_start)",
    "rank_colors": f"with {FRAMED}, {NAMES}, {RANKED} select * from ranked",
    "color_names": f"with {LOG}, {NAMES} select p.*, {NAMED} from p left join names using (pixel_color)",
    "first_time_users": f"""with {LOG} select count(*) as first_time_users from (
  select user_id_hashed, min(timestamp) as first_placement from p group by user_id_hashed)
where first_placement >= {_ts(FIRST_START)} and first_placement <= {_ts(FIRST_END)}""",
    "first_time_users_kept": f"""with {LOG} select count(*) as first_time_users from (
  select user_id_hashed, min(timestamp) as first_placement from p group by user_id_hashed)
where first_placement >= {_ts(FIRST_START)} and first_placement <= {_ts(FIRST_END)}""",
    "sessions_across_loads": f"""with {LONG_SESSIONS}
select user_id_hashed, min(timestamp) as session_start, max(timestamp) as session_end, cast(sum(placements) as bigint) as placements,
  extract(epoch from max(timestamp) - min(timestamp)) as session_seconds from sessions group by user_id_hashed, session_id""",
    "canvas_at_moment": f"""with {LOG} select x, y, pixel_color from (
  select x, y, pixel_color, row_number() over (partition by x, y order by timestamp desc, pixel_color desc) as rn
  from p where {PAINTS} and timestamp < {_ts(START)}) where rn = 1""",
    "placement_percentiles": f"with {FRAMED}, {PER_USER} {PERCENTILES}",
    "frame_report": f"""with {SESSIONS}, {NAMES}, {RANKED}, {PER_USER}, pct as ({PERCENTILES})
select 'color_users' as section, rank as position, color as label, cast(distinct_users as double) as value from ranked
union all select 'average_session_seconds', 1, null, avg_session_seconds from ({AVERAGE})
union all select 'placement_percentile', cast(round(percentile * 100) as int), null, placements from pct
union all select 'first_time_users', 1, null, cast(count(*) as double) from (
  select user_id_hashed, min(timestamp) as first_placement from p group by user_id_hashed)
where first_placement >= {_ts(START)} and first_placement <= {_ts(END)}""",
    "top_pixels": f"with {LOG} select * from {TOP_PIXELS.format(k=10)}",
    "top_colors_per_pixel": f"with {LOG}, {NAMES} select * from ("
    + _pixel_colors(f"(x, y) in (select (x, y) from {TOP_PIXELS.format(k=3)})")
    + ") where rank <= 3",
    "pixel_colors": f"with {LOG}, {NAMES} " + _pixel_colors(f"(x, y) in ({PIXEL_LIST})"),
    "distinct_pixels": f"with {LOG} select distinct x, y from p",
    "top_users": f"with {LOG}, {TOP_USERS.format(k=50)} select * from t",
    "user_positions": f"with {LOG}, {TOP_USERS.format(k=10)} select x, y, user_id_hashed, pixel_color, timestamp "
    "from p where user_id_hashed in (select user_id_hashed from t)",
    "canvas_region": f"with {REGION} select x, y, x - {CENTER_X - RADIUS} as dx, y - {CENTER_Y - RADIUS} as dy, "
    f"pixel_color, {_rgb('pixel_color')} from cells",
    "canvas_region_dense": f"with {REGION}, {GRID}, {_dense('#000000')}",
    "user_canvas": f"""with {LOG}, {TOP_USERS.format(k=10)}, {GRID}, cells as (
  select x, y, pixel_color from (
    select x, y, pixel_color, row_number() over (partition by x, y order by timestamp, pixel_color) as rn
    from p where user_id_hashed in (select user_id_hashed from t) and {PAINTS}) where rn = 1), {_dense('#FFFFFF')}""",
    "hex_to_rgb": f"with {LOG} select p.*, {_rgb('pixel_color')} from p",
}
