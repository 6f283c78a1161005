"""Tables that are carried from load to load: each load makes a new version, or none.

A version is a folder ``version=N`` with the rows, and in ``loads`` the names of
all loads that went into them. The rows are written first, the loads last, and
Spark's committer marks a finished write with ``_SUCCESS``; only a version whose
loads are marked counts. So a load that dies half way leaves the version before
it in force, and a load whose name is known already changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


class KeptTable:
    """A kept table at ``path``.

    ``fold(new_rows)`` makes the state of a load's rows, ``merge(union)`` makes
    one state of two that are unioned; merging must not depend on the order.
    One writer at a time: two that write at once would make the same version,
    and the second fails as its folder exists.
    """

    def __init__(self, spark: SparkSession, path: str, fold: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.fold, self.merge = spark, path.rstrip("/"), fold, merge

    def _at(self, version: int, part: str) -> str:
        return f"{self.path}/version={version}/{part}"

    def versions(self) -> list[int]:
        """Finished versions, oldest first."""
        where, system = _folder(self.spark, self.path)
        if not system.exists(where):
            return []
        names = [status.getPath().getName() for status in system.listStatus(where)]
        numbers = sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))
        return [n for n in numbers if system.exists(_folder(self.spark, self._at(n, "loads/_SUCCESS"))[0])]

    def loads(self) -> list[str]:
        """Names of the loads that are in the table."""
        done = self.versions()
        if not done:
            return []
        return sorted(r.load for r in self.spark.read.schema("load string").parquet(self._at(done[-1], "loads")).collect())

    def read(self, version: int | None = None) -> DataFrame:
        """The rows after the last load, or of an older version."""
        done = self.versions()
        if not done:
            raise ValueError(f"nothing was loaded into {self.path}")
        return self.spark.read.parquet(self._at(done[-1] if version is None else version, "rows"))

    def load(self, name: str, new_rows: DataFrame, keep: int = 2) -> bool:
        """Merge the rows of the load ``name``; False if it is in the table already.

        The kept rows are read, the history is not. Versions older than the last
        ``keep`` are removed, as are the remains of loads that did not finish.
        """
        if name in self.loads():
            return False
        state = self.fold(new_rows)
        if self.versions():
            state = self.merge(self.read().unionByName(state))
        self.commit(name, state, keep)
        return True

    def commit(self, name: str, state: DataFrame, keep: int = 2) -> None:
        """Make ``state`` the table's rows after the load ``name``."""
        done, known = self.versions(), self.loads()
        version = done[-1] + 1 if done else 1
        self._remove(version)
        state.write.parquet(self._at(version, "rows"))
        names = self.spark.createDataFrame([(n,) for n in [*known, name]], "load string")
        names.coalesce(1).write.parquet(self._at(version, "loads"))
        for old in done[: max(0, len(done) + 1 - keep)]:
            self._remove(old)

    def _remove(self, version: int) -> None:
        where, system = _folder(self.spark, f"{self.path}/version={version}")
        system.delete(where, True)
