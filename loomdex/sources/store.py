"""Small state tables of a workspace (sessions, logs, scores) as Parquet below a shared folder.

A table that is rewritten gets a new version folder, and the newest complete one counts, so a
writer that is lost leaves the old state. A log is only ever added to.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _folders(self, name: str) -> list[str]:
        """Complete versions or parts of a table, oldest first."""
        fs, top = self._fs(f"{self.root}/{name}")
        if not fs.exists(top):
            return []
        done = [f.getPath() for f in fs.listStatus(top) if f.isDirectory()]
        return sorted(str(p.getName()) for p in done if fs.exists(self._fs(f"{self.root}/{name}/{p.getName()}/_SUCCESS")[1]))

    def read(self, name: str, schema: str) -> DataFrame:
        """The newest version, or no rows."""
        found = self._folders(name)
        if not found:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{found[-1]}")

    def write(self, name: str, table: DataFrame) -> None:
        """A new version; the one before stays for its readers, older ones go."""
        found = self._folders(name)
        number = int(found[-1].removeprefix("v")) + 1 if found else 0
        table.write.mode("overwrite").parquet(f"{self.root}/{name}/v{number:012d}")
        for old in found[:-1]:
            fs, target = self._fs(f"{self.root}/{name}/{old}")
            fs.delete(target, True)

    def append(self, log: str, rows: DataFrame) -> None:
        rows.write.mode("errorifexists").parquet(f"{self.root}/{log}/part-{uuid.uuid4().hex}")

    def read_log(self, log: str, schema: str) -> DataFrame:
        found = self._folders(log)
        if not found:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{log}/{f}" for f in found])
