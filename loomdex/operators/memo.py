"""Which files a session has read and whether reading them again is needless.

Events: session_id, seq, ts (timestamp), event (read, edit, pre_compact, session_start,
session_end, select), path, content_hash, tokens. Arrival order is (ts, seq).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import recommendation

IDLE_SECONDS = 600


def lives(events: DataFrame, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """``events`` plus life (a session starts anew after an end or an idle gap) and segment
    (a compaction forgets files but not counters)."""
    order = Window.partitionBy("session_id").orderBy("ts", "seq")
    gap = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(order))
    starts = F.when((gap > idle_seconds) | (F.lag("event").over(order) == "session_end"), 1).otherwise(0)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = events.withColumn("__s", starts).withColumn("life", F.sum("__s").over(so_far)).drop("__s")
    inside = Window.partitionBy("session_id", "life").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.withColumn("segment", F.count_if(F.col("event") == "pre_compact").over(inside))


def reads(events: DataFrame, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """Every read with redundant (the last thing that happened to the path in this segment
    was a read with the same hash), known_tokens and tokens_saved.

    Known tokens are the larger of before and observed, but a redundant read that reports
    tokens sets them anew; each such read opens a run, within which they are a running
    maximum, so windows express the fold.
    """
    return folded(lives(events, idle_seconds))


def folded(keyed: DataFrame) -> DataFrame:
    """``reads`` of events that have life and segment already."""
    touched = keyed.where(F.col("event").isin("read", "edit") & F.col("path").isNotNull())
    path = Window.partitionBy("session_id", "life", "segment", "path").orderBy("ts", "seq")
    same = (F.lag("event").over(path) == "read") & F.lag("content_hash").over(path).eqNullSafe(F.col("content_hash"))
    marked = touched.withColumn("redundant", (F.col("event") == "read") & F.coalesce(same, F.lit(False)))
    observed = F.coalesce("tokens", F.lit(0))
    so_far = path.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = marked.withColumn("observed", F.when(F.col("event") == "read", observed).otherwise(0))
    marked = marked.withColumn("run", F.sum(F.when(F.col("redundant") & (F.col("observed") > 0), 1).otherwise(0)).over(so_far))
    run = Window.partitionBy("session_id", "life", "segment", "path", "run").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = marked.withColumn("known_tokens", F.max("observed").over(run))
    saved = F.when(F.col("redundant"), F.greatest("known_tokens", "observed")).otherwise(0)
    return marked.where("event = 'read'").withColumn("tokens_saved", saved).drop("observed", "run")


def totals(events: DataFrame, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """Per session and life: total_reads, redundant_reads_prevented, tokens_saved, compaction_count."""
    keys = ["session_id", "life"]
    r = reads(events, idle_seconds).groupBy(*keys).agg(F.count("*").alias("total_reads"), F.count_if("redundant").alias("redundant_reads_prevented"), F.sum("tokens_saved").alias("tokens_saved"))
    c = lives(events, idle_seconds).groupBy(*keys).agg(F.count_if(F.col("event") == "pre_compact").alias("compaction_count"))
    zero = F.lit(0).cast("long")
    return c.join(r, keys, "left").select(*keys, *[F.coalesce(n, zero).alias(n) for n in ("total_reads", "redundant_reads_prevented", "tokens_saved", "compaction_count")])


def idle_sessions(events: DataFrame, now, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """session_id, last_activity and whether it is idle at ``now`` (timestamp column)."""
    last = events.groupBy("session_id").agg(F.max("ts").alias("last_activity"))
    return last.withColumn("idle", (F.unix_timestamp(now) - F.unix_timestamp("last_activity")) > idle_seconds)


def tracked(events: DataFrame, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """Files of each session's last life and segment: content_hash and tokens of the last
    read, read_count, edited (a change was seen since)."""
    keyed = lives(events, idle_seconds)
    newest = keyed.groupBy("session_id").agg(F.max(F.struct("life", "segment")).alias("at"))
    r = reads(events, idle_seconds).join(newest, "session_id").where("life = at.life and segment = at.segment")
    last = F.struct("ts", "seq", "content_hash", "known_tokens")
    files = r.groupBy("session_id", "path").agg(F.max(last).alias("r"), F.count("*").alias("read_count"))
    edits = keyed.where("event = 'edit'").groupBy("session_id", "path").agg(F.max(F.struct("ts", "seq")).alias("e"))
    joined = files.join(edits, ["session_id", "path"], "left")
    edited = F.coalesce(F.col("e") > F.struct("r.ts", "r.seq"), F.lit(False))
    return joined.select("session_id", "path", "r.content_hash", F.col("r.known_tokens").alias("tokens"), "read_count", edited.alias("edited"))


def check(files: DataFrame, disk: DataFrame) -> DataFrame:
    """Status and recommendation of tracked files against the contents on disk (path,
    disk_hash, disk_tokens). The disk decides: an edit without a change is fresh again, a
    missing file is stale."""
    j = files.join(disk, "path", "left")
    stale = F.col("disk_hash").isNull() | (F.col("disk_hash") != F.col("content_hash"))
    now = F.when(stale, F.col("disk_tokens"))
    return j.select(
        "session_id", "path", F.when(stale, "stale").otherwise("fresh").alias("status"), recommendation(stale, now, F.col("tokens")).alias("recommendation"),
        F.col("tokens").alias("tokens_at_last_read"), now.alias("current_tokens"),
    )


def broadcast_changes(changes: DataFrame, files: DataFrame) -> DataFrame:
    """A changed path becomes an edit event in every session that tracks it."""
    return files.join(changes.select("path").distinct(), "path").select("session_id", "path", F.lit("edit").alias("event"))
