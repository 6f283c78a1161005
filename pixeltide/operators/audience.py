"""Questions about the users of a frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixeltide.functions.color import with_color_names
from pixeltide.functions.time import Moment, as_range, moment
from pixeltide.operators.filters import until, within_frame


PERCENTAGES = (0.50, 0.75, 0.90, 0.99)

#: Leading characters of a colour code that split the numbering.
PREFIX = 4


def ranked_colors(per_color: DataFrame) -> DataFrame:
    """Rank, code, name and users of ``per_color(pixel_color, distinct_users)``, most users first, then by code.

    A dirty log may hold any number of codes, so they are not numbered in one
    task: a histogram over (users, first characters of the code) gives what
    comes before each group, and codes are numbered within their group.
    """
    # NULL sorts before all codes, as in an ORDER BY.
    grouped = per_color.selectExpr("*", f"substring(coalesce(pixel_color, ''), 1, {PREFIX}) as prefix")
    before = "over (order by distinct_users desc, prefix rows between unbounded preceding and 1 preceding)"
    offsets = grouped.groupBy("distinct_users", "prefix").agg(F.expr("count(*) as codes"))
    offsets = offsets.selectExpr("distinct_users", "prefix", f"coalesce(sum(codes) {before}, 0) as offset")
    number = "row_number() over (partition by distinct_users, prefix order by pixel_color) as number"
    numbered = grouped.selectExpr("*", number).join(offsets, ["distinct_users", "prefix"])
    return with_color_names(numbered).selectExpr(
        "cast(offset + number as int) as rank", "pixel_color", "color", "distinct_users"
    )


def percentiles_of(per_user: DataFrame, percentages: Sequence[float]) -> DataFrame:
    """Exact percentiles, linearly interpolated, of ``per_user(n)``.

    Users are first folded into a histogram (how many users have n), so the
    last task sees one row per distinct n and not one per user.
    """
    histogram = per_user.groupBy("n").agg(F.expr("count(*) as users"))
    wanted = ", ".join(f"{float(p)!r}D" for p in percentages)
    rows = ", ".join(
        f"named_struct('percentile', {float(p)!r}D, 'placements', values[{i}], 'whole_placements', cast(values[{i}] as int))"
        for i, p in enumerate(percentages)
    )
    values = histogram.agg(F.expr(f"percentile(n, array({wanted}), users) as values"))
    return values.selectExpr(f"inline(array({rows}))")


def rank_colors_by_distinct_users(
    log: DataFrame,
    start: Moment,
    end: Moment,
    end_inclusive: bool = True,
) -> DataFrame:
    """Colours of the frame, most distinct users first, with rank and name.

    Grouped by code, so the two codes named "Dark cyan 2" stay apart. The exact
    distinct count first shuffles (colour, user) pairs, which spreads a dominant
    colour over all tasks.
    """
    per_color = (
        within_frame(log, start, end, end_inclusive)
        .groupBy("pixel_color")
        .agg(F.count_distinct("user_id_hashed").alias("distinct_users"))
    )
    return ranked_colors(per_color)


def count_first_time_users(
    log: DataFrame,
    start: Moment,
    end: Moment,
    end_inclusive: bool = True,
) -> DataFrame:
    """How many users placed their very first pixel inside the frame.

    The first placement is taken over the whole history. Rows after the frame
    cannot make a first placement earlier, so the scan stops at its end; rows
    before the frame must stay.
    """
    first, last = as_range(start, end)
    firsts = (
        until(log, last, end_inclusive)
        .groupBy("user_id_hashed")
        .agg(F.min("timestamp").alias("first_placement"))
    )
    return firsts.filter(F.col("first_placement") >= moment(first)).agg(
        F.count("*").alias("first_time_users")
    )


def placement_percentiles(
    log: DataFrame,
    start: Moment,
    end: Moment,
    percentages: Sequence[float] = PERCENTAGES,
    end_inclusive: bool = True,
) -> DataFrame:
    """Exact percentiles, linearly interpolated, of the placements per user, one row per percentage."""
    per_user = (
        within_frame(log, start, end, end_inclusive)
        .groupBy("user_id_hashed")
        .agg(F.count("*").alias("n"))
    )
    return percentiles_of(per_user, percentages)
