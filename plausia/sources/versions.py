"""A folder whose contents count by a list: what a job writes is seen once the list that names it is complete."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..cluster import fresh_path, remove_path


class Versions:
    """Pairs of a part's number and its version, in a row of lists of which the last complete one counts.

    Readers see all of a change or none of it; a job that fails leaves nothing that anyone reads. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, label: str = "store"):
        self.spark, self.path = spark, path or fresh_path(spark, label)

    def _hadoop(self, name: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, folder: str = "") -> list[str]:
        where, fs = self._hadoop(folder)
        return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []

    def exists(self, name: str) -> bool:
        where, fs = self._hadoop(name)
        return fs.exists(where)

    def lists(self) -> list[int]:
        return sorted(int(n[1:]) for n in self.names("lists") if self.exists(f"lists/{n}/_SUCCESS"))

    def current(self) -> list[tuple[int, int]]:
        lists = self.lists()
        if not lists:
            return []
        return sorted(map(tuple, self.spark.read.schema("part int, version int").json(f"{self.path}/lists/v{lists[-1]}").collect()))

    def commit(self, pairs: list[tuple[int, int]]) -> None:
        number = 1 + max(self.lists(), default=0)
        self.spark.createDataFrame(sorted(pairs), "part int, version int").coalesce(1).write.mode("overwrite").json(f"{self.path}/lists/v{number}")

    def forget_lists(self) -> None:
        """Removes all lists but the one that counts."""
        for n in self.lists()[:-1]:
            remove_path(self.spark, f"{self.path}/lists/v{n}")

    def remove(self, name: str) -> None:
        remove_path(self.spark, f"{self.path}/{name}")

    def drop(self) -> None:
        remove_path(self.spark, self.path)
