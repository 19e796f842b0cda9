"""Watching a tree: a stream of ticks, each of which lists the tree and applies what changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index as ix, segments
from ..sources.ignore import ignored
from ..sources.tree import searchable
from . import changes

LISTING = "relative_path string, modified_unix_secs long, length long"


def file_events(before: DataFrame, after: DataFrame) -> DataFrame:
    """path and kind (created, changed, deleted) between two listings (``LISTING``)."""
    b = before.select("relative_path", F.struct("modified_unix_secs", "length").alias("b"))
    a = after.select("relative_path", F.struct("modified_unix_secs", "length").alias("a"))
    kind = F.when(F.col("b").isNull(), "created").when(F.col("a").isNull(), "deleted").when(F.col("a") != F.col("b"), "changed")
    return b.join(a, "relative_path", "full_outer").select(F.col("relative_path").alias("path"), kind.alias("kind")).where("kind is not null")


def relevant(events: DataFrame, index_folder: str = "", rules: list[tuple[str, str]] = (), include_hidden: bool = False) -> DataFrame:
    """Events of paths that an index would hold: inside the tree, not in the index's own
    folder, not hidden and not ignored. A change of an ignore file always counts."""
    path = F.col("path")
    inside = ~path.startswith("../") & ~path.startswith("/")
    if index_folder:
        inside = inside & (path != index_folder) & ~path.startswith(f"{index_folder.rstrip('/')}/")
    rule_file = F.element_at(F.split(path, "/"), -1).isin(".gitignore", ".ignore")
    return events.where(inside & (rule_file | (searchable(path, include_hidden) & ~ignored(path, list(rules)))))


def index_feed(spark: SparkSession, events: DataFrame, read: Callable[[DataFrame], DataFrame], index_path: str, checkpoint: str, rules: list[tuple[str, str]] = ()):
    """A writer (call ``start``) that applies a stream of changes (path, kind, ts) to an index,
    file by file: a batch reads the files that it names and no others, and is applied once, as its
    number is the generation that the index keeps. ``read`` gives the documents of a table of
    paths (relative_path)."""

    def write(batch: DataFrame, number: int) -> None:
        kept = relevant(batch.withColumnRenamed("relative_path", "path"), rules=rules).withColumnRenamed("path", "relative_path")
        segments.apply_feed(spark, index_path, kept, read, number)

    return changes.feed(events, write, checkpoint)


def watch(spark: SparkSession, listing: Callable[[], DataFrame], read: Callable[[DataFrame], DataFrame], index_path: str, checkpoint: str, rules: list[tuple[str, str]] = (), every: str = "1 second", told: Callable[[int, dict], None] | None = None):
    """A writer (call ``start``) that keeps an index up to date where nothing tells of changes:
    at each tick the tree is listed, and the files that differ from what is indexed, no
    others, are read and become a segment. A tick that is run again finds nothing left to do."""

    def step(_: DataFrame, number: int) -> None:
        now = ix.load(spark, index_path).docs
        held = now.select("relative_path", "modified_unix_secs", F.col("size").alias("length"))
        changed = relevant(file_events(held, listing()), rules=rules).select(F.col("path").alias("relative_path"), (F.col("kind") == "deleted").alias("deleted")).cache()
        n = changed.count()
        if n:
            docs = read(changed.where("not deleted").select("relative_path"))
            m = segments.change(spark, index_path, docs, changed.select("relative_path"), now=number)
            if told:
                told(number, {"changed": n, "docs": m.docs, "version": m.version})
        changed.unpersist()

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=every)
