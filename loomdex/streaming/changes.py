"""File changes as a stream: coalescing and applying them to an index or its log.

A change that is lost leaves an index stale, so no stream here has a watermark: what arrives
late is in the batch that it arrives in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUIET = "500 milliseconds"


def coalesce(events: DataFrame, quiet: str = QUIET) -> DataFrame:
    """One row for each path and batch of changes (path, kind, ts) of a table: a batch closes
    after ``quiet``; deleted is sticky."""
    return events.groupBy(F.session_window("ts", quiet).alias("batch"), "path").agg(F.max(F.col("kind") == "deleted").alias("deleted"), F.count("*").alias("events"))


def feed(events: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, quiet: str = QUIET):
    """A writer (call ``start``) that gives ``write`` each micro-batch of a stream of changes
    (path, kind, ts): relative_path and deleted, one row a path, with the number of the batch. Changes
    of a path that are no more than ``quiet`` apart are one, of which any deletion counts; of several the
    newest counts. What is late is in the batch that it comes with."""

    def step(batch: DataFrame, number: int) -> None:
        newest = F.max_by(F.struct("deleted"), F.col("batch.end")).alias("c")
        write(coalesce(batch, quiet).groupBy(F.col("path").alias("relative_path")).agg(newest).select("relative_path", "c.deleted"), number)

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def renames(events: DataFrame) -> DataFrame:
    """A rename (path, new_path) is a deletion and a creation."""
    kept = events.where("kind != 'renamed'").select("path", "kind", "ts")
    moved = events.where("kind = 'renamed'")
    return kept.union(moved.select("path", F.lit("deleted"), "ts")).union(moved.select("new_path", F.lit("created"), "ts"))


def append_log(stream: DataFrame, log: str, checkpoint: str):
    """Writes each micro-batch of changed documents to an append-only log with its batch
    number (the generation). Replays of a batch overwrite its own folder only."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{log}/batch={number}/data")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
