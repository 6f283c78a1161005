"""Colour names and RGB parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The canvas palette. Two codes share the name "Dark cyan 2".
PALETTE = {
    "#000000": "Black",
    "#00756F": "Dark cyan 2",
    "#009EAA": "Dark Cyan",
    "#00A368": "Dark cyan 2",
    "#00CC78": "Lime green",
    "#00CCC0": "Cyan",
    "#2450A4": "Dark blue",
    "#3690EA": "Bright blue",
    "#493AC1": "Moderate blue",
    "#515252": "Very dark grayish cyan",
    "#51E9F4": "Soft cyan",
    "#6A5CFF": "Light blue",
    "#6D001A": "Very dark red",
    "#6D482F": "Dark orange",
    "#7EED56": "Soft green",
    "#811E9F": "Dark magenta",
    "#898D90": "Dark grayish blue",
    "#94B3FF": "Very light blue",
    "#9C6926": "Brown",
    "#B44AC0": "Magenta",
    "#BE0039": "Strong pink",
    "#D4D7D9": "Light grayish blue",
    "#DE107F": "Vivid pink",
    "#E4ABFF": "Pale violet",
    "#FF3881": "Light pink",
    "#FF4500": "Orange",
    "#FF99AA": "Very light red",
    "#FFA800": "Orange 2",
    "#FFB470": "Very light orange",
    "#FFD635": "Light yellow",
    "#FFF8B8": "Pale yellow",
    "#FFFFFF": "White",
}
UNKNOWN = "Unknown"


def color_names_table(spark: SparkSession) -> DataFrame:
    """The palette as ``(pixel_color, color)``, an in-plan table of 32 rows."""
    rows = ", ".join(f"('{code}', '{name}')" for code, name in PALETTE.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS palette(pixel_color, color)")


def with_color_names(df: DataFrame) -> DataFrame:
    """Add ``color``, the name of ``pixel_color``; codes off the palette are "Unknown".

    The broadcast side has the fixed 32 rows of the palette.
    """
    named = df.join(F.broadcast(color_names_table(df.sparkSession)), "pixel_color", "left")
    return named.withColumn("color", F.coalesce("color", F.lit(UNKNOWN)))


def hex_to_rgb(code: Column | str) -> tuple[Column, Column, Column]:
    """Red, green and blue (0-255) of ``#RRGGBB``; NULL if it is not such a code."""
    column = F.col(code) if isinstance(code, str) else code
    digits = F.ltrim(column, F.lit("#"))
    valid = digits.rlike("^[0-9A-Fa-f]{6}$")

    def channel(start: int, name: str) -> Column:
        value = F.conv(F.substring(digits, start, 2), 16, 10).cast("int")
        return F.when(valid, value).alias(name)

    return channel(1, "r"), channel(3, "g"), channel(5, "b")


def with_rgb(df: DataFrame, column: str = "pixel_color") -> DataFrame:
    """Add the int columns ``r``, ``g`` and ``b``."""
    return df.select("*", *hex_to_rgb(column))
