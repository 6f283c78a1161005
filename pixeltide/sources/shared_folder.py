"""Where written tables go: the folder all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else the context's checkpoint folder, else the warehouse folder.

    The warehouse counts as shared unless it is a plain local folder of a
    session that runs on other machines too; that is an error, since a table
    written there would be lost with its executor.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        chosen = context._jsc.sc().getCheckpointDir()
        folder = chosen.get() if chosen.isDefined() else None
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir")
        if folder.startswith(("file:", "/")) and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there is removed when the program ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:  # registered after the session's own hooks, so it runs before them
        atexit.unregister(_leave_nothing)
        atexit.register(_leave_nothing)
    _made[path] = spark
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Remove a table made at a path of ``fresh_path``."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _made.pop(path, None)


def drop_all(spark: SparkSession) -> None:
    """Remove all tables made for ``spark`` so far; also run at the end of the program."""
    for path in [p for p, owner in _made.items() if owner is spark]:
        drop(spark, path)


def _leave_nothing() -> None:
    for path, spark in list(_made.items()):
        if spark.sparkContext._jsc is not None:
            try:
                drop(spark, path)
            except Exception:  # noqa: BLE001  the JVM may have gone first
                return
