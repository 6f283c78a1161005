"""The hottest cells and their colours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixeltide.functions.color import with_color_names
from pixeltide.operators.counts import count_by
from pixeltide.operators.filters import at_pixels


def top_pixels(log: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most painted cells; ties go to the smaller x, then y."""
    return count_by(log, "x", "y").orderBy(F.desc("placements"), "x", "y").limit(k)


def top_colors_per_pixel(
    log: DataFrame,
    pixels: DataFrame | Sequence[tuple[int, int]],
    n: int | None = 3,
) -> DataFrame:
    """The ``n`` most used colours of each given cell, named; all of them if ``n`` is None.

    Placements are counted per (cell, colour) before they are ranked, so a hot
    cell is ranked on one row per colour.
    """
    counts = count_by(at_pixels(log, pixels), "x", "y", "pixel_color").withColumnRenamed(
        "placements", "frequency"
    )
    by_cell = Window.partitionBy("x", "y").orderBy(F.desc("frequency"), "pixel_color")
    ranked = counts.withColumn("rank", F.row_number().over(by_cell))
    if n is not None:
        ranked = ranked.filter(F.col("rank") <= n)
    return (
        with_color_names(ranked)
        .select("x", "y", "rank", "pixel_color", "color", "frequency")
        .orderBy("x", "y", "rank")
    )
