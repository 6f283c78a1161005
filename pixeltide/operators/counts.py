"""Counts per key and distinct cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_by(log: DataFrame, *keys: str) -> DataFrame:
    """Placements per key; NULL keys are a group of their own.

    Counts are combined before the shuffle, so a key with a large share of the
    rows arrives as one row per input task.
    """
    return log.groupBy(*keys).agg(F.count("*").alias("placements"))


def distinct_pixels(log: DataFrame) -> DataFrame:
    """The cells that were painted at least once."""
    return log.select("x", "y").distinct()
