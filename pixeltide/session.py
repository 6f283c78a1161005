"""Session builder with the settings the operators are meant to run under."""

from __future__ import annotations

from pyspark.sql import SparkSession

# AQE picks the final partition count and splits skewed join partitions, so the
# initial count only has to be large enough for the biggest shuffle.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.compression.codec": "zstd",
}


def build_session(app_name: str = "pixeltide", master: str | None = None, **settings: str) -> SparkSession:
    """A session with ``DEFAULTS``; ``settings`` use ``__`` where Spark uses a dot.

    On a cluster leave ``master`` to spark-submit and size
    ``spark.sql.shuffle.partitions`` to the data (about 128 MB of shuffle each).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
