"""Portable sessions: action log, working set, snapshots, resume, briefs and packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import line_range, sha256
from .frecency import restore as restore_scores

# The headers of a brief.
HEADERS = ("## Goal", "## Current hypothesis", "## Established facts", "## Ruled out", "## Open questions", "## Next planned action")


def record(log: DataFrame, actions: DataFrame) -> DataFrame:
    """``actions`` (session_id, ts, seq, kind, payload) appended with the next entry ids."""
    last = log.agg(F.coalesce(F.max("entry_id"), F.lit(0)).alias("last"))
    ids = actions.crossJoin(F.broadcast(last)).withColumn("entry_id", F.col("last") + F.row_number().over(Window.orderBy("ts", "seq")))  # last is one row
    return log.unionByName(ids.select(*log.columns))


def upsert(sessions: DataFrame, opened: DataFrame, now: int) -> DataFrame:
    """Sessions (session_id, goal, status, created_at, updated_at) after opening some: a closed
    one opens again, a blank goal keeps the old one."""
    o = opened.select("session_id", F.col("goal").alias("g"), F.lit(True).alias("o"))
    j = sessions.join(o, "session_id", "full_outer")
    goal = F.when(F.trim(F.coalesce("g", F.lit(""))) != "", F.col("g")).otherwise(F.coalesce("goal", F.lit("")))
    is_open = F.col("o").isNotNull()
    return j.select("session_id", goal.alias("goal"), F.when(is_open, "open").otherwise(F.col("status")).alias("status"), F.coalesce("created_at", F.lit(now)).alias("created_at"), F.when(is_open, F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"))


def close(sessions: DataFrame, session_ids: list[str], now: int) -> DataFrame:
    hit = F.col("session_id").isin(*session_ids)
    return sessions.withColumn("status", F.when(hit, "closed").otherwise(F.col("status"))).withColumn("updated_at", F.when(hit, F.lit(now)).otherwise(F.col("updated_at")))


def newest_open(sessions: DataFrame) -> DataFrame:
    return sessions.where("status = 'open'").orderBy(F.desc("updated_at"), "session_id").limit(1)


def files_read(log: DataFrame, pinned: DataFrame | None = None) -> DataFrame:
    """session_id, path, sha, last_read_at: the first read or check of each path; a pinned
    snippet of the path goes before."""
    path, sha = F.get_json_object("payload", "$.path"), F.coalesce(F.get_json_object("payload", "$.sha"), F.lit(""))
    rows = log.where(F.col("kind").isin("read", "memo_check")).select("session_id", path.alias("path"), sha.alias("sha"), F.lit(1).alias("rank"), "entry_id", F.col("ts").alias("last_read_at")).where("path is not null")
    if pinned is not None:
        rows = rows.unionByName(pinned.select("session_id", "path", "sha", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("entry_id"), "last_read_at"))
    first = rows.groupBy("session_id", "path").agg(F.min_by(F.struct("sha", "last_read_at"), F.struct("rank", "entry_id")).alias("f"))
    return first.select("session_id", "path", "f.sha", "f.last_read_at")


def searches_run(log: DataFrame) -> DataFrame:
    field = lambda p: F.get_json_object("payload", p)
    return log.where("kind = 'search'").select(
        "session_id", F.concat(F.lit("action-"), F.col("entry_id").cast("string")).alias("search_id"), F.coalesce(field("$.query"), field("$.pattern"), F.lit("")).alias("query"),
        F.coalesce(field("$.kind"), F.lit("search")).alias("search_kind"), F.coalesce(F.from_json(field("$.result_paths"), "array<string>"), F.array().cast("array<string>")).alias("result_paths"), "entry_id",
    )


def pinned_snippets(specs: DataFrame, docs: DataFrame) -> DataFrame:
    """Snippets (path, line_start, line_end) with content and sha of those lines."""
    good = (F.col("line_start") > 0) & (F.col("line_end") >= F.col("line_start"))
    checked = specs.withColumn("line_start", F.when(good, F.col("line_start")).otherwise(F.raise_error(F.lit("invalid pinned snippet range")).cast("int")))
    joined = checked.join(docs.select(F.col("relative_path").alias("path"), "contents"), "path")
    text = line_range(F.col("contents").cast("string"), F.col("line_start"), F.col("line_end"))
    return joined.select("path", "line_start", "line_end", text.alias("content")).withColumn("sha", sha256(F.col("content")))


def diff_files(a: DataFrame, b: DataFrame) -> DataFrame:
    """path and change (added, removed, changed) between two snapshots' files (path, sha)."""
    j = a.select("path", F.col("sha").alias("x")).join(b.select("path", F.col("sha").alias("y")), "path", "full_outer")
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.col("x") != F.col("y"), "changed")
    return j.select("path", change.alias("change")).where("change is not null")


def diff_searches(a: DataFrame, b: DataFrame) -> DataFrame:
    ids = lambda d: d.select("search_id").distinct()
    return ids(b).subtract(ids(a)).withColumn("change", F.lit("added")).union(ids(a).subtract(ids(b)).withColumn("change", F.lit("removed")))


def write_snapshot(files: DataFrame, searches: DataFrame, log: DataFrame, root: str, snapshot_id: str) -> str:
    """A snapshot as Parquet below root/snapshots/<id>; an id that exists is not written over."""
    base = f"{root}/snapshots/{snapshot_id}"
    for name, df in (("files", files), ("searches", searches), ("action_log", log)):
        df.write.mode("errorifexists").parquet(f"{base}/{name}")
    return base


def resume(files: DataFrame, present: DataFrame, frecency: DataFrame, saved: DataFrame, now: int) -> dict[str, DataFrame]:
    """What resuming does: files to prime, stale ones that are gone, restored scores."""
    here = present.select(F.col("relative_path").alias("path"))
    return {"primed": files.join(here, "path", "left_semi"), "stale": files.join(here, "path", "left_anti"), "frecency": restore_scores(frecency, saved, now)}


def hydration(files: DataFrame, searches: DataFrame, snapshot_id: str, budget_tokens: int = 3000) -> DataFrame:
    """One row: payload in Markdown (the first 40 files and searches) and its token estimate;
    cut at the budget's bytes on a character boundary."""
    f = files.orderBy("path").limit(40).agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("- "), "path", F.lit(" ("), "sha", F.lit(")")))), "\n").alias("f"))
    s = searches.orderBy("entry_id").limit(40).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("entry_id", F.concat(F.lit("- ["), "search_id", F.lit("] "), "search_kind", F.lit(": "), "query", F.lit(" -> "), F.array_join("result_paths", ", ")).alias("t")))), lambda x: x["t"]), "\n").alias("s"))
    text = F.concat(F.lit(f"# Hydration payload\n\n- snapshot_id: {snapshot_id}\n\n## Working Set\n"), "f", F.lit("\n\n## Searches\n"), "s", F.lit("\n"))
    out = f.crossJoin(s).select(text.alias("payload"))  # one row each
    most = max(budget_tokens * 4, 512)
    raw = F.encode("payload", "UTF-8")
    heads = [F.substring(raw, 1, most - i).cast("string") for i in range(4)]  # one of them ends with a whole character
    cut = F.concat(F.coalesce(*[F.when(F.is_valid_utf8(h), h) for h in heads]), F.lit("\n\n[truncated to hydration budget]\n"))
    out = out.select(F.when(F.octet_length("payload") > most, cut).otherwise(F.col("payload")).alias("payload"))
    return out.withColumn("token_estimate", F.ceil(F.octet_length("payload") / F.lit(4.0)))


BRIEF_FACTS = 12


def briefs(log: DataFrame, goal: str = "Continue the captured session.") -> DataFrame:
    """session_id and markdown: a brief of each session with its first BRIEF_FACTS actions as
    cited facts."""
    ident = F.concat(F.lit(" [action_log:"), F.col("entry_id").cast("string"), F.lit("]"))
    query = F.coalesce(F.get_json_object("payload", "$.query"), F.lit("unknown query"))
    path = F.coalesce(F.get_json_object("payload", "$.path"), F.lit("unknown path"))
    fact = F.when(F.col("kind") == "search", F.concat(F.lit("- Ran search `"), query, F.lit("`"), ident)).when(F.col("kind") == "memo_check", F.concat(F.lit("- Checked freshness of `"), path, F.lit("`"), ident)).otherwise(F.concat(F.lit("- Recorded "), "kind", ident))
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy("entry_id"))
    first = log.select("session_id", "entry_id", fact.alias("t")).withColumn("nth", nth).where(F.col("nth") <= BRIEF_FACTS)
    facts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "t"))), lambda x: x["t"]), "\n")
    return first.groupBy("session_id").agg(facts.alias("facts")).select("session_id", _brief(F.col("facts"), goal).alias("markdown"))


def _brief(facts: Column, goal: str) -> Column:
    return F.concat(F.lit(f"## Goal\n{goal}\n\n## Current hypothesis\n(none)\n\n## Established facts\n"), facts, F.lit("\n\n## Ruled out\n(none identified)\n\n## Open questions\n- What should be verified first?\n\n## Next planned action\nCheck one captured fact before editing.\n"))


def brief(log: DataFrame, goal: str = "Continue the captured session.") -> DataFrame:
    """One row: the brief of a log, whatever its sessions; without actions it says so."""
    one = briefs(log.withColumn("session_id", F.lit("")), goal).select("markdown")
    none = log.sparkSession.range(1).select(_brief(F.lit("(none captured)"), goal).alias("none"))
    return none.join(one, F.lit(True), "left").select(F.coalesce("markdown", "none").alias("markdown"))  # one row each


def brief_problems(briefs: DataFrame, log: DataFrame) -> DataFrame:
    """problem: missing headers, more than 6000 bytes, citations of entries that do not exist."""
    missing = F.array(*[F.when(~F.col("markdown").contains(h), F.lit(f"missing header {h}")) for h in HEADERS])
    size = F.array(F.when(F.octet_length("markdown") > 6000, F.lit("over 6000 bytes")))
    fixed = briefs.select(F.explode(F.concat(missing, size)).alias("problem")).where("problem is not null")
    cited = briefs.select(F.explode(F.regexp_extract_all("markdown", F.lit(r"(?m)^- .*\[action_log:([^\]]*)\]"), 1)).alias("id"))
    unknown = cited.join(log.select(F.col("entry_id").cast("string").alias("id")), "id", "left_anti").select(F.concat(F.lit("unknown citation "), "id").alias("problem"))
    return fixed.union(unknown)


def checksums(files: DataFrame) -> DataFrame:
    return files.select("path", F.sha2("contents", 256).alias("sha256"))


def mismatches(expected: DataFrame, files: DataFrame) -> DataFrame:
    """Paths whose checksum differs or that are missing."""
    found = checksums(files).withColumnRenamed("sha256", "found")
    return expected.join(found, "path", "left").where(~F.col("sha256").eqNullSafe(F.col("found"))).select("path", "sha256", "found")


def import_id(wanted: str, taken: list[str]) -> str:
    """The first of id, id-1, id-2, ... that is free."""
    n, name = 0, wanted
    while name in taken:
        n += 1
        name = f"{wanted}-{n}"
    return name


# Names by which harnesses are called.
_HARNESS = {"claude": "claude_code", "claude_code": "claude_code", "claudecode": "claude_code", "codex": "codex", "codex_cli": "codex"}


def normalize_harness(value: str) -> str:
    name = value.strip().lower().replace("-", "_")
    if name not in _HARNESS:
        raise ValueError(f"unsupported harness {value}")
    return _HARNESS[name]


# How the harnesses are shown and how each is told to resume a snapshot.
_SHOWN = {"claude_code": "Claude", "codex": "Codex"}
_RESUME = {"claude_code": "/", "codex": "$"}


def handoff_block(source: str | None, target: str, session_id: str, snapshot_id: str, brief: str, tool: str = "loomdex") -> str:
    """What a user pastes into another harness to go on with a session."""
    head = [f"{tool} handoff ready", ""]
    about = {"From": _SHOWN.get(source, "unknown"), "To": _SHOWN[target], "Session": session_id, "Snapshot": snapshot_id, "Brief": brief}
    tail = ["", f"In {_SHOWN[target]}, paste:", f"  {_RESUME[target]}{tool} resume {snapshot_id}"]
    return "\n".join([*head, *(f"{k}: {v}" for k, v in about.items()), *tail])
