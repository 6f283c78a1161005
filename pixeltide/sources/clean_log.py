"""The clean log as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixeltide.functions.time import day_key, hour_key
from pixeltide.sources.schema import CLEAN, DAY, FOLDER_MARK, HOUR

FOLDERS = {"hour": (HOUR, hour_key), "day": (DAY, day_key)}

#: Cells on a side of a tile.
TILE = 64
ORDERS = {
    "tile": (f"floor(x / {TILE})", f"floor(y / {TILE})", "timestamp"),
    "user": ("user_id_hashed", "timestamp"),
    "time": ("timestamp",),
}


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The clean log, with its folder column if it was clustered by time.

    Fails if a column of the clean log is missing or has another type. The
    folder column and the timestamp are marked as belonging together (column
    metadata): only then do frame filters use the folders, so a column that
    merely has such a name changes nothing. A recomputed timestamp or folder
    column loses its mark; a union has the marks of its first part.
    """
    log = spark.read.parquet(path)
    found = {f.name: f.dataType.simpleString() for f in log.schema}
    wrong = [f"{f.name} {f.dataType.simpleString()}" for f in CLEAN if found.get(f.name) != f.dataType.simpleString()]
    if wrong:
        raise ValueError(f"no clean log at {path}: expected {', '.join(wrong)}, found {found}")
    for column in (HOUR, DAY):
        if column in found:
            mark = {FOLDER_MARK: column}
            log = log.withMetadata(column, mark).withMetadata("timestamp", mark)
    return log


def write_log(
    log: DataFrame,
    path: str,
    folders: str | None = "hour",
    order: str = "tile",
    zstd_level: int | None = None,
    mode: str = "errorifexists",
) -> None:
    """Write the log as zstd Parquet.

    ``folders`` clusters it by time: one folder per ``hour`` (for frames of
    hours) or ``day`` (for a small log over a long time). A frame filter then
    reads only its own folders. Spark does not prune Parquet row groups on
    zone-less timestamps, whatever the plan lists as pushed, so time is left to
    the folders and ``order`` sorts the rows within one: by ``tile`` of 64 x 64
    cells, so that questions about a region or some cells read only the pages
    of their tiles; by ``user``, for questions about some users; or by ``time``. The
    rebalance hint brings the rows of a folder together in one pass over the
    source, and lets AQE split a folder that is larger than
    ``spark.sql.adaptive.advisoryPartitionSizeInBytes`` over as many tasks (and
    files) as it needs. With None, rows are written where they are read.
    """
    log = log.drop(HOUR, DAY)
    if folders is not None:
        (column, key), within = FOLDERS[folders], ORDERS[order]
        log = (
            log.withColumn(column, key("timestamp"))
            .hint("rebalance", F.col(column))
            .sortWithinPartitions(column, *map(F.expr, within))
        )
    writer = log.write.mode(mode).option("compression", "zstd")
    if zstd_level is not None:
        writer = writer.option("parquet.compression.codec.zstd.level", str(zstd_level))
    if folders is not None:
        writer = writer.partitionBy(column)
    writer.parquet(path)
