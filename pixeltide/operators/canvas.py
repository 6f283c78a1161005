"""The state of the canvas as a table of coloured cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixeltide.functions.color import with_rgb
from pixeltide.functions.time import Moment
from pixeltide.operators.filters import in_box, within_frame
from pixeltide.operators.users import user_positions

BLACK = "#000000"
WHITE = "#FFFFFF"


def final_cells(placements: DataFrame, policy: str = "latest") -> DataFrame:
    """The colour that each painted cell ends up with.

    ``latest`` keeps the last placement, ``earliest`` the first. At one instant
    the larger (or smaller) code wins. Placements without time or colour win
    no cell.

    Time is first taken per (cell, colour), a hash aggregate on fixed-width
    buffers that is combined before the shuffle. What remains, at most one row
    per cell and colour, is then decided per cell.
    """
    if policy not in ("latest", "earliest"):
        raise ValueError(f"policy must be latest or earliest: {policy}")
    pick = F.max if policy == "latest" else F.min
    per_color = (
        placements.filter(F.col("pixel_color").isNotNull() & F.col("timestamp").isNotNull())
        .groupBy("x", "y", "pixel_color")
        .agg(pick("timestamp").alias("timestamp"))
    )
    return (
        per_color.groupBy("x", "y")
        .agg(pick(F.struct("timestamp", "pixel_color")).alias("kept"))
        .select("x", "y", "kept.pixel_color")
    )


def canvas_region(
    log: DataFrame,
    cx: int,
    cy: int,
    radius: int = 50,
    start: Moment | None = None,
    end: Moment | None = None,
    policy: str = "latest",
) -> DataFrame:
    """The painted cells around (cx, cy) with their offset in the region and RGB.

    Cells never painted are absent; ``dense_grid`` adds them.
    """
    inside = log.filter(in_box(cx, cy, radius))
    if start is not None and end is not None:
        inside = within_frame(inside, start, end)
    elif start is not None or end is not None:
        raise ValueError("give both start and end, or neither")
    cells = final_cells(inside, policy).select(
        "x",
        "y",
        (F.col("x") - F.lit(cx - radius)).alias("dx"),
        (F.col("y") - F.lit(cy - radius)).alias("dy"),
        "pixel_color",
    )
    return with_rgb(cells)


def dense_grid(
    cells: DataFrame,
    x0: int,
    y0: int,
    width: int,
    height: int,
    background: str = BLACK,
) -> DataFrame:
    """Every cell of a width x height grid; ``background`` where nothing was painted.

    The grid is a viewport: painted cells outside it are not shown.
    The grid comes from one numbered range, cut into x and y.
    """
    grid = cells.sparkSession.range(width * height).select(
        F.expr(f"cast(id % {int(width)} + {int(x0)} as int)").alias("x"),
        F.expr(f"cast(id div {int(width)} + {int(y0)} as int)").alias("y"),
    )
    filled = grid.join(cells.select("x", "y", "pixel_color"), ["x", "y"], "left").select(
        "x",
        "y",
        (F.col("x") - F.lit(x0)).alias("dx"),
        (F.col("y") - F.lit(y0)).alias("dy"),
        F.coalesce("pixel_color", F.lit(background)).alias("pixel_color"),
    )
    return with_rgb(filled)


def user_canvas(
    log: DataFrame,
    users: DataFrame | Sequence[int],
    width: int = 2000,
    height: int = 2000,
    policy: str = "earliest",
    background: str = WHITE,
    clip: bool = False,
) -> DataFrame:
    """The whole canvas with only what the given users painted, one row per cell.

    The default keeps each cell's first placement by these users. A placement
    outside the canvas is an error, found while the rows are read; ``clip`` cuts
    such placements off instead. Placements without a cell (a NULL coordinate)
    are on no canvas.
    """
    painted = user_positions(log, users)
    inside = F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)
    if clip:
        painted = painted.filter(inside)
    else:
        outside = F.concat_ws(",", F.lit("outside the canvas:"), "x", "y")
        known = painted.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
        painted = known.withColumn("x", F.when(inside, F.col("x")).otherwise(F.raise_error(outside)))
    return dense_grid(final_cells(painted, policy), 0, 0, width, height, background)
