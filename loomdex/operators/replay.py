"""Replaying traces of tool calls: what the memo of read files would have saved, and whether it
would ever have been wrong.

Calls have run_id, turn, name, input and answer (JSON text), text and cwd, as
``sources/traces.tool_calls`` gives them. All paths are taken relative to cwd.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import memo

# Shell commands that read a file, in the order in which they are tried.
SHELL_READS = [rf"\b{name}\s+(?:-[^\s]*\s+)*([^-\s|;&][^\s|;&]*)" for name in ("cat", "head", "tail", "nl")] + [r"\bsed\s+-n\s+['\"][^'\"]+['\"]\s+([^-\s|;&][^\s|;&]*)"]
EDITS = ("Edit", "MultiEdit", "Write")


def text_at(record: Column, *paths: str) -> Column:
    """The first of these places of a variant that holds a JSON string."""
    at = lambda p: F.when(F.schema_of_variant(F.try_variant_get(record, p, "variant")) == "STRING", F.try_variant_get(record, p, "string"))
    return F.coalesce(*[at(p) for p in paths])


def relative(path: Column, cwd: Column) -> Column:
    """Below cwd without it; elsewhere without the slash that it starts with."""
    home = F.concat(F.rtrim(cwd, F.lit("/")), F.lit("/"))
    return F.when(path.startswith(home), F.substring(path, F.length(home) + 1, F.length(path))).otherwise(F.ltrim(path, F.lit("/")))


def read_path(name: Column, input: Column, answer: Column) -> Column:
    """Input and answer are variants. The file that a Read call or a reading shell command names; null if it is none."""
    line = text_at(input, "$.command")
    shell = F.coalesce(*[F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in SHELL_READS])
    return F.when(name == "Read", F.coalesce(text_at(answer, "$.file.filePath"), text_at(input, "$.file_path"))).when(name == "Bash", F.btrim(shell, F.lit("\"'")))


def edit_path(name: Column, input: Column, answer: Column) -> Column:
    return F.when(name.isin(*EDITS), F.coalesce(F.nullif(text_at(input, "$.file_path"), F.lit("")), text_at(answer, "$.filePath")))


def file_events(calls: DataFrame) -> DataFrame:
    """run_id, turn, kind (read, edit), path, data (what a read showed, what a Write wrote) and
    edits (pairs to replace). Reads that showed nothing and calls without a path are left out;
    so are calls without a turn, which have no place in the run."""
    n, i, a = F.col("name"), F.col("__i"), F.col("__a")
    shown = F.coalesce(text_at(a, "$.file.content"), text_at(a, "$.content"), text_at(a, "$.stdout"), F.col("text"), F.lit(""))
    pair = "struct<old_string:string,new_string:string>"
    edits = F.when(n == "Edit", F.array(F.try_variant_get(i, "$", pair))).when(n == "MultiEdit", F.try_variant_get(i, "$.edits", f"array<{pair}>"))
    parsed = calls.select("run_id", "turn", "name", "text", "cwd", F.try_parse_json("input").alias("__i"), F.try_parse_json("answer").alias("__a"))
    out = parsed.select(
        "run_id", F.col("turn").cast("long").alias("turn"), F.when(n.isin(*EDITS), "edit").otherwise("read").alias("kind"), F.coalesce(edit_path(n, i, a), read_path(n, i, a)).alias("path"), F.col("cwd"),
        F.when(n == "Write", F.coalesce(text_at(i, "$.content"), F.lit(""))).when(~n.isin(*EDITS), shown).alias("data"), edits.alias("edits"),
    )
    kept = out.where(F.col("turn").isNotNull() & (F.col("path") != "") & ((F.col("kind") == "edit") | (F.col("data") != "")))
    return kept.withColumn("path", F.coalesce(relative(F.col("path"), F.col("cwd")), F.ltrim("path", F.lit("/")))).drop("cwd")


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the digest of the file as each event leaves it. Rows come in order of run, path and
    turn, so one file's contents are all that is held."""
    at, disk, digest = None, None, None
    for batch in batches:
        digests = []
        for run, path, data, edits in zip(*(batch.column(c).to_pylist() for c in ("run_id", "path", "data", "edits"))):
            if (run, path) != at:
                at, disk, digest = (run, path), None, None
            before = disk
            if edits is not None and disk is not None:
                for e in edits:
                    disk = disk.replace((e or {}).get("old_string") or "", (e or {}).get("new_string") or "", 1)
            elif edits is None and data is not None:
                disk = data
            if disk is not before:
                digest = hashlib.sha256(disk.encode("utf-8", "surrogatepass")).hexdigest()
            digests.append(digest)
        keep = [batch.column(c) for c in ("run_id", "turn", "kind", "path", "tokens")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(digests, pa.string())], ["run_id", "turn", "kind", "path", "tokens", "content_hash"])


def disk_states(events: DataFrame) -> DataFrame:
    """run_id, turn, kind, path, tokens (of reads) and content_hash: the digest of the whole file
    after each event, null while it does not exist. A file is what its first read showed, then what
    edits made of it; later reads, which may show a part, do not change it."""
    order = Window.partitionBy("run_id", "path").orderBy("turn")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    tokens = F.when(F.col("kind") == "read", F.ceil(F.octet_length("data") / F.lit(3.5)))
    # of reads only the first that may make the file goes to Python with its text
    exists = F.coalesce(F.max(F.col("data").isNotNull()).over(upto), F.lit(False))
    data = F.when((F.col("kind") == "edit") | ~exists, F.col("data"))
    edits = F.when((F.col("kind") == "read") | F.col("data").isNotNull(), None).otherwise(F.coalesce("edits", F.array().cast("array<struct<old_string:string,new_string:string>>")))
    placed = events.repartition("run_id", "path").select("run_id", "turn", "kind", "path", tokens.alias("tokens"), data.alias("data"), edits.alias("edits"))
    run = events.schema["run_id"].dataType.simpleString()
    return placed.sortWithinPartitions("run_id", "path", "turn").mapInArrow(_states, f"run_id {run}, turn long, kind string, path string, tokens long, content_hash string")


def replay_reads(calls: DataFrame, compact_at: Column | int | None = None) -> DataFrame:
    """Every read with memo_status (what the memo says of the file just before: fresh, stale or
    unknown), seen (known since the last compaction), eligible (read since, and not edited after
    that), wrong (called fresh though it has changed), after_compaction (the first read of a
    file known before it), and what ``memo.reads`` tells. After turn ``compact_at`` of a run its
    files are forgotten; null: never."""
    cut = compact_at if isinstance(compact_at, Column) else F.lit(compact_at).cast("long")
    states = disk_states(file_events(calls)).withColumn("segment", F.coalesce((F.col("turn") > cut).cast("long"), F.lit(0)))
    order = Window.partitionBy("run_id", "segment", "path").orderBy("turn")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col("content_hash").isNotNull(), F.col("kind"))
    told = states.withColumns({
        "last_kind": F.last(known, True).over(upto), "last_hash": F.last("content_hash", True).over(upto),
        "read_hash": F.last(F.when(F.col("kind") == "read", F.col("content_hash")), True).over(upto),
    })
    fresh = F.coalesce(F.col("read_hash") == F.col("content_hash"), F.lit(False))
    before = Window.partitionBy("run_id", "path").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    known_before = F.coalesce(F.max((F.col("segment") == 0) & F.col("content_hash").isNotNull()).over(before), F.lit(False))
    told = told.withColumns({
        "memo_status": F.when(F.col("read_hash").isNull(), "unknown").when(fresh, "fresh").otherwise("stale"), "seen": F.col("last_kind").isNotNull(), "eligible": F.coalesce(F.col("last_kind") == "read", F.lit(False)),
        "wrong": F.col("last_kind").isNotNull() & fresh & (F.col("content_hash") != F.col("last_hash")), "after_compaction": (F.col("segment") > 0) & F.col("read_hash").isNull() & known_before,
    })
    events = told.withColumnsRenamed({"run_id": "session_id", "turn": "seq", "kind": "event"}).withColumns({"ts": F.timestamp_seconds("seq"), "life": F.lit(0)})
    return memo.folded(events).withColumnsRenamed({"session_id": "run_id", "seq": "turn"}).drop("ts", "life", "event", "last_kind", "last_hash", "read_hash")


def replay(calls: DataFrame, compact_at: Column | int | None = None) -> DataFrame:
    """One row for each run that reads: what it read, what the memo saves, and its mistakes.
    Both kinds of mistakes are 0 by construction here: the memo's state and the disk are
    computed from the same calls, so they hold the definition and measure no memo of another kind."""
    tokens, fresh = F.col("tokens"), F.col("memo_status") == "fresh"
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    return replay_reads(calls, compact_at).groupBy("run_id").agg(
        F.count("*").alias("total_reads"), F.count_if("redundant").alias("redundant_reads_prevented"), total("tokens_saved", "tokens_saved"), F.count_if("wrong").alias("false_negatives"),
        F.count_if(F.col("after_compaction") & fresh).alias("post_compact_false_negatives"), total(tokens, "actual_navigation_tokens"), total(F.when(F.col("seen") & fresh, 0).otherwise(tokens), "memo_navigation_tokens"),
        total(F.when(F.col("eligible"), tokens), "memo_eligible_redundant_tokens"),
    )
