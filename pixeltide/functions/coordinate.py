"""The two forms of a cell: text ``x,y`` and two int columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_coordinate(text: Column | str, strict: bool = True) -> tuple[Column, Column]:
    """``x`` and ``y`` of a text coordinate; parts after the second are ignored.

    A missing or non-numeric part is an error, or NULL when not ``strict``.
    """

    def part(number: int) -> Column:
        piece = F.split_part(F.col(text) if isinstance(text, str) else text, F.lit(","), F.lit(number))
        return piece.cast("int") if strict else piece.try_cast("int")

    return part(1).alias("x"), part(2).alias("y")


def coordinate_text(x: Column | str = "x", y: Column | str = "y") -> Column:
    """Text ``x,y``; NULL if either is NULL."""
    left = F.col(x) if isinstance(x, str) else x
    right = F.col(y) if isinstance(y, str) else y
    return F.concat(left.cast("string"), F.lit(","), right.cast("string"))
