"""The most active users and where they painted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixeltide.operators.counts import count_by


def top_users(log: DataFrame, limit: int = 50) -> DataFrame:
    """The ``limit`` users with the most placements; ties go to the smaller key."""
    return count_by(log, "user_id_hashed").orderBy(F.desc("placements"), "user_id_hashed").limit(limit)


def user_positions(
    log: DataFrame,
    users: DataFrame | Sequence[int],
    newest_first: bool = False,
) -> DataFrame:
    """All placements of the given users.

    ``users`` is a list of keys, pushed down to the scan, or a DataFrame such as
    ``top_users(..)``, semi-joined within the same plan. Spark broadcasts it
    only if its size, known from the LIMIT, is below the threshold.
    ``newest_first`` sorts the result; the further sort columns let Spark split
    a single moment over several tasks.
    """
    if isinstance(users, DataFrame):
        chosen = log.join(users.select("user_id_hashed"), "user_id_hashed", "left_semi")
    else:
        chosen = log.filter(F.col("user_id_hashed").isin([int(u) for u in users]))
    rows = chosen.select("x", "y", "user_id_hashed", "pixel_color", "timestamp")
    if newest_first:
        rows = rows.orderBy(F.desc("timestamp"), "user_id_hashed", "x", "y", "pixel_color")
    return rows
