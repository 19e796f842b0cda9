"""Lineage cuts in the folder that driver and executors share.

The folder comes from ``spark.checkpoint.dir``. Only a local master without that
setting (tests) gets a temporary folder of its own, which goes when Python ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get(_KEY, None)
    if found:
        return found
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise ValueError(f"{_KEY} must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="loomdex-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    made = f"file://{folder}"
    spark.conf.set(_KEY, made)
    return made


class Scratch:
    """Parquet tables for one operator call, deleted on exit.

    ``table`` writes a frame once, so that later steps read it instead of running
    its lineage again, and a lost executor costs one step only. ``keep`` is for the
    result: a reliable checkpoint, which outlives the call. Spark removes it when nothing
    refers to it any more where spark.cleaner.referenceTracking.cleanCheckpoints is true
    (``loomdex.session`` sets that); otherwise it stays until its folder is emptied.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/loomdex-{label}-{uuid.uuid4().hex}"

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *exc) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, df: DataFrame) -> DataFrame:
        sc = self.spark.sparkContext
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(shared_dir(self.spark))
        return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """Broadcast hint for a materialised narrow frame, only after counting its rows;
    beyond the bound the planner is left to shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def text_of(df: DataFrame, column: str = "text"):
    """The text column as string."""
    return F.col(column).cast("string")
