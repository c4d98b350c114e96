"""Where an index keeps its tables. A store has a name under which settings ask for it; the one here lays
versioned Parquet folders below a folder of any file system Spark can reach."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

STORES: dict[str, Callable[[SparkSession, str], ParquetStore]] = {}
#: Versions of a log that are put together once there are more.
MOST_VERSIONS = 64


def register_store(name: str):
    def add(factory):
        STORES[name] = factory
        return factory

    return add


def open_store(name: str, spark: SparkSession, folder: str):
    if name not in STORES:
        raise KeyError(f"no store {name!r}; there are {sorted(STORES)}")
    return STORES[name](spark, folder)


@register_store("parquet")
class ParquetStore:
    """Tables as folders of versions; a version counts once it is whole, so no reader sees half of one."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def versions(self, name: str) -> list[str]:
        fs, path = self._fs()
        at = path(f"{self.folder}/{name}")
        if not fs.exists(at):
            return []
        found = [s.getPath() for s in fs.listStatus(at)]
        return sorted(p.toString() for p in found if fs.exists(path(p.toString() + "/_SUCCESS")))

    def new_version(self, name: str) -> str:
        return f"{self.folder}/{name}/v{time.time_ns():020d}"

    def save(self, name: str, df: DataFrame) -> DataFrame:
        version = self.new_version(name)
        df.write.parquet(version)
        return self.spark.read.parquet(version)

    def newest(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.versions(name)[-1])

    def log(self, name: str) -> DataFrame:
        """All versions together, of tables that are appended to."""
        return self.spark.read.parquet(*self.versions(name))

    def append(self, name: str, df: DataFrame) -> None:
        """Adds rows; where many versions have come together they become one."""
        self.save(name, df.coalesce(1))
        old = self.versions(name)
        if len(old) > MOST_VERSIONS:
            self.save(name, self.spark.read.parquet(*old).coalesce(1))
            fs, path = self._fs()
            for version in old:
                fs.delete(path(version), True)

    def delete(self, name: str) -> None:
        fs, path = self._fs()
        fs.delete(path(f"{self.folder}/{name}"), True)
