"""A table of versions: every write makes a new folder of Parquet files, and a small file names the current one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.operators import store


class SnapshotTable:
    """A folder v=N for each version, on any file system that Spark reaches. There is one writer; readers keep the version they began with."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The current version; 0 before the first write."""
        if not self._fs.exists(self._path(f"{self.path}/current")):
            return 0
        return int(self.spark.read.text(f"{self.path}/current").first()["value"])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the current one by default; none before the first write."""
        n = self.version() if version is None else version
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={n}") if n else self.spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame) -> int:
        """Write rows as the next version. What fails on the way leaves the current version as it is."""
        n = self.version() + 1
        rows.write.mode("overwrite").parquet(f"{self.path}/v={n}")
        self.spark.createDataFrame([(str(n),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/next")
        if self._fs.exists(self._path(f"{self.path}/current")):
            self._fs.delete(self._path(f"{self.path}/current"), True)
        self._fs.rename(self._path(f"{self.path}/next"), self._path(f"{self.path}/current"))
        return n

    def upsert(self, rows: DataFrame, key: str = "id") -> int:
        return self.write(store.upsert(self.read(), rows.select(self.read().columns), key))

    def delete(self, keys: DataFrame, key: str = "id") -> int:
        return self.write(store.delete(self.read(), keys, key))

    def rebuild(self, key: str = "id") -> int:
        """Write the readable rows anew, one a key, and drop older versions but the one before, which is the backup."""
        n = self.write(store.latest(self.read().filter(F.col(key).isNotNull()), key))
        for old in range(1, n - 1):
            self._fs.delete(self._path(f"{self.path}/v={old}"), True)
        return n
