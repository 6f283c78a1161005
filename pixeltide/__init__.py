"""Pixel log analytics on Spark.

A pixel log says which user put which colour at which cell of a shared canvas,
and when. Every operator takes and returns DataFrames; nothing is collected.
"""

from pixeltide.functions.color import color_names_table, hex_to_rgb, with_color_names, with_rgb
from pixeltide.functions.coordinate import coordinate_text, split_coordinate
from pixeltide.functions.time import in_frame, parse_timestamp, seconds_between
from pixeltide.operators.audience import (
    count_first_time_users,
    placement_percentiles,
    rank_colors_by_distinct_users,
)
from pixeltide.operators.canvas import canvas_region, dense_grid, final_cells, user_canvas
from pixeltide.operators.counts import count_by, distinct_pixels
from pixeltide.operators.filters import at_pixels, in_box, within_frame
from pixeltide.operators.frames import (
    mode_coordinate_in_frame,
    mode_in_frame,
    timeframe_modes,
    timeframe_summary,
)
from pixeltide.operators.kept_state import (
    CanvasHistory,
    SessionHistory,
    count_first_time_users_of,
    days_between,
    first_placements,
    kept_first_placements,
    painted_cells,
)
from pixeltide.operators.many_frames import frame_modes, frames_summary, sliding_frames
from pixeltide.operators.pixels import top_colors_per_pixel, top_pixels
from pixeltide.operators.sessions import (
    average_session_length,
    session_assignments,
    session_durations,
    session_flags,
    sessionize,
)
from pixeltide.operators.users import top_users, user_positions
from pixeltide.plans.frame_report import FrameReport, frame_report
from pixeltide.sources.clean_log import read_log, write_log
from pixeltide.sources.kept_table import KeptTable
from pixeltide.sources.raw_csv import Ingested, checked_csv, clean_log, ingest_checked, ingest_csv, read_raw_csv, timed_raw_log

__all__ = [
    "CanvasHistory",
    "FrameReport",
    "KeptTable",
    "SessionHistory",
    "at_pixels",
    "average_session_length",
    "canvas_region",
    "Ingested",
    "checked_csv",
    "clean_log",
    "ingest_checked",
    "color_names_table",
    "coordinate_text",
    "count_by",
    "count_first_time_users",
    "count_first_time_users_of",
    "days_between",
    "dense_grid",
    "distinct_pixels",
    "final_cells",
    "first_placements",
    "frame_modes",
    "frame_report",
    "frames_summary",
    "hex_to_rgb",
    "in_box",
    "in_frame",
    "kept_first_placements",
    "ingest_csv",
    "mode_coordinate_in_frame",
    "mode_in_frame",
    "painted_cells",
    "parse_timestamp",
    "placement_percentiles",
    "rank_colors_by_distinct_users",
    "read_log",
    "read_raw_csv",
    "seconds_between",
    "session_assignments",
    "session_durations",
    "session_flags",
    "sessionize",
    "sliding_frames",
    "split_coordinate",
    "timed_raw_log",
    "timeframe_modes",
    "timeframe_summary",
    "top_colors_per_pixel",
    "top_pixels",
    "top_users",
    "user_canvas",
    "user_positions",
    "with_color_names",
    "with_rgb",
    "within_frame",
    "write_log",
]
