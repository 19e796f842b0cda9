"""The tool surface: named calls with checked arguments over one workspace's index and state.

``Workspace.call`` never raises for bad input: it returns {"ok": True, "result": ...} or
{"ok": False, "error": {"code", "message"}}. All state lives in ``sources.store`` tables.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.request import InvalidQuery, SearchRequest
from ..sources import git
from ..sources.store import Store
from . import envelope as env
from . import frecency, index as ix, memo, pack, reuse, search as se, sessions

# The names, fields and limits of the tool interface.
_TEXT, _FLAG = {"type": "string"}, {"type": "boolean", "default": False}
_LIMIT = {"type": "integer", "minimum": 1, "maximum": env.HARD_LIMIT, "default": env.DEFAULT_LIMIT}
_MODE = {"type": "string", "enum": ["literal", "regex"], "default": "literal"}
_RANGE = {"type": "object", "properties": {"path": _TEXT, "line_start": {"type": "integer", "minimum": 1}, "line_end": {"type": "integer", "minimum": 1}}, "required": ["path", "line_start", "line_end"]}
_FIELDS: dict[str, dict[str, dict]] = {
    "find_files": {"query": _TEXT, "limit": _LIMIT, "force_refresh": _FLAG},
    "search_content": {"query": _TEXT, "mode": _MODE, "limit": _LIMIT, "force_refresh": _FLAG},
    "search_path_and_content": {"path_query": _TEXT, "content_query": _TEXT, "mode": _MODE, "limit": _LIMIT, "force_refresh": _FLAG},
    "context_pack": {"goal": _TEXT, "intent": {"type": "string", "enum": ["bugfix", "review"], "default": "bugfix"}, "budget_tokens": {"type": "integer", "minimum": 1, "maximum": 4000, "default": 1200}, "max_files": {"type": "integer", "minimum": 1, "maximum": 12, "default": 4}, "changed_files": {"type": "array", "items": _TEXT}},
    "index_status": {},
    "reindex": {"mode": {"type": "string", "enum": ["incremental", "full"], "default": "incremental"}},
    "memo_status": {"files": {"type": "array", "items": _TEXT, "minItems": 1}, "session_id": _TEXT},
    "memo_session": {"session_id": _TEXT},
    "memo_check": {"path": _TEXT, "session_id": _TEXT},
    "session_open": {"session_id": _TEXT, "goal": {"type": "string", "default": ""}},
    "session_status": {"session_id": _TEXT},
    "session_list": {},
    "session_close": {"session_id": _TEXT, "status": {"type": "string", "enum": ["resolved", "abandoned"], "default": "resolved"}},
    "session_snapshot": {"session_id": _TEXT, "source_harness": _TEXT, "source_model": _TEXT, "pinned_snippet_paths": {"type": "array", "items": _RANGE}},
    "session_snapshot_list": {"session_id": _TEXT},
    "session_snapshot_get": {"snapshot_id": _TEXT},
    "session_snapshot_diff": {"snapshot_a": _TEXT, "snapshot_b": _TEXT},
    "session_resume": {"snapshot_id": _TEXT, "budget_tokens": {"type": "integer", "minimum": 1, "maximum": 12000}},
    "session_handoff": {"session_id": _TEXT, "target_harness": _TEXT, "source_harness": _TEXT},
}
_REQUIRED = {
    "find_files": ["query"], "search_content": ["query"], "search_path_and_content": ["path_query", "content_query"], "context_pack": ["goal"], "memo_status": ["files"], "memo_check": ["path"],
    "session_snapshot_get": ["snapshot_id"], "session_snapshot_diff": ["snapshot_a", "snapshot_b"], "session_resume": ["snapshot_id"], "session_handoff": ["target_harness"],
}
SCHEMAS = {name: {"type": "object", "properties": fields, "required": _REQUIRED.get(name, []), "additionalProperties": False} for name, fields in _FIELDS.items()}

#: Rows of a list that one call returns.
PAGE = 1000

SESSIONS = "session_id string, goal string, status string, created_at long, updated_at long"
LOG = "entry_id long, session_id string, ts long, kind string, payload string"
EVENTS = "session_id string, seq long, ts timestamp, event string, path string, content_hash string, tokens long"
JOURNAL = "generation long, path string"
SEARCHES = "session_id string, seq long, key string, generation long, epoch long, matched_paths array<string>, search_id string, counts map<string,long>"
SNAPSHOTS = "snapshot_id string, session_id string, created_at long, source_harness string, source_model string, git_commit string, dirty_files array<string>, changed_lines map<string,long>"
FILES = "session_id string, path string, sha string, last_read_at long"
RAN = "session_id string, search_id string, query string, search_kind string, result_paths array<string>, entry_id long"
SCORES = "path string, score double, last_access_secs long, result_count long, select_count long"
_KINDS = {"string": str, "integer": int, "boolean": bool, "array": list, "object": dict}


class ToolError(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def checked(value, schema: dict, at: str = "arguments"):
    """``value`` with defaults; a ToolError says where it breaks the schema."""
    kind = _KINDS[schema["type"]]
    if not isinstance(value, kind) or kind is int and isinstance(value, bool):
        raise ToolError("INVALID_QUERY", f"{at}: not {schema['type']}")
    if "enum" in schema and value not in schema["enum"]:
        raise ToolError("INVALID_QUERY", f"{at}: not one of {', '.join(schema['enum'])}")
    if kind is int and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        raise ToolError("INVALID_QUERY", f"{at}: out of range")
    if kind is list:
        if len(value) < schema.get("minItems", 0):
            raise ToolError("INVALID_QUERY", f"{at}: too few")
        return [checked(v, schema["items"], f"{at}[{i}]") for i, v in enumerate(value)]
    if kind is dict:
        known = schema["properties"]
        for name in value:
            if name not in known:
                raise ToolError("INVALID_QUERY", f"{at}.{name}: unknown")
        for name in schema["required"]:
            if name not in value:
                raise ToolError("INVALID_QUERY", f"{at}.{name}: missing")
        given = {n: checked(v, known[n], f"{at}.{n}") for n, v in value.items()}
        return {n: s["default"] for n, s in known.items() if "default" in s} | given
    return value


class Workspace:
    """An index below ``root``/index and the state of its sessions below ``root``/state.
    ``scan`` gives the documents as they are now (relative_path, file_name, extension, size,
    modified_unix_secs, hash, contents, doc_id); ``tree`` is their folder, for git."""

    def __init__(self, spark: SparkSession, root: str, scan: Callable[[], DataFrame], tree: str | None = None, session_id: str | None = None, clock: Callable[[], float] = time.time):
        self.spark, self.root, self.scan, self.tree, self.clock = spark, root.rstrip("/"), scan, tree, clock
        self.session, self.store = session_id, Store(spark, f"{root.rstrip('/')}/state")

    def call(self, name: str, arguments: dict | None = None) -> dict:
        try:
            if name not in SCHEMAS:
                raise ToolError("INVALID_QUERY", f"unknown tool {name}")
            return {"ok": True, "result": getattr(self, name)(**checked(arguments or {}, SCHEMAS[name]))}
        except ToolError as e:
            code, message = e.code, str(e)
        except InvalidQuery as e:
            code, message = "INVALID_QUERY", str(e)
        except FileNotFoundError as e:
            code, message = "INDEX_UNAVAILABLE", str(e)
        except ix.Conflict as e:
            code, message = "BACKEND_FAILURE", str(e)
        except AnalysisException as e:
            missing = e.getCondition() == "PATH_NOT_FOUND"
            code, message = "INDEX_UNAVAILABLE" if missing else "BACKEND_FAILURE", str(e).split("\n")[0]
        return {"ok": False, "error": {"code": code, "message": message}}

    # searching

    def _index(self) -> ix.Index:
        return ix.load_current(self.spark, f"{self.root}/index")

    def _generation(self) -> int:
        return int(self.store.read_log("journal", JOURNAL).agg(F.coalesce(F.max("generation"), F.lit(0))).first()[0])

    def _epoch(self) -> int:
        """How often a context has been lost so far: session starts and compactions."""
        return self.store.read_log("events", EVENTS).where(F.col("event").isin("session_start", "pre_compact")).count()

    def _found(self, request: SearchRequest, limit: int, force_refresh: bool) -> dict:
        """An envelope, or word that the earlier result of the same search still holds: the same
        request to its last field and limit, in the same epoch, with no change since to a path
        that it matched or that falls under its filters."""
        request = se.compiled(self.spark, request)
        session, key = self._session(None), json.dumps([asdict(request), limit])
        current, epoch = self._generation(), self._epoch()
        known = self.store.read_log("searches", SEARCHES).where((F.col("session_id") == session) & (F.col("key") == key)).orderBy(F.desc("seq")).limit(1)
        journal = self.store.read_log("journal", JOURNAL)
        if not force_refresh and (last := known.first()):
            asked = self.spark.createDataFrame([(1, last["generation"], last["epoch"], last["matched_paths"])], "request_id int, recorded_generation long, recorded_epoch long, matched_paths array<string>")
            verdict = reuse.check(asked, reuse.newest_batches(journal), F.lit(current), F.lit(epoch), se.in_scope(request, F.col("path"))).first()
            if verdict["fresh"]:
                return {"version": "1", "reused": True, "search_id": last["search_id"], "reason": verdict["reason"], "paths": last["matched_paths"], "counts": last["counts"] or {}, "cache": "hit"}
        out = env.envelope(self._index(), request, limit) | {"reused": False}
        paths = list(dict.fromkeys(r["relative_path"] for r in out["results"]))
        number = self.store.read_log("searches", SEARCHES).where(F.col("session_id") == session).count() + 1
        out["search_id"] = f"search-{number:06d}"
        self.store.append("searches", self.spark.createDataFrame([(session, number, key, current, epoch, paths, out["search_id"], out["counts"])], SEARCHES))
        self._record(session, "search", {"query": request.pattern, "kind": request.effective_kind, "result_paths": paths})
        if paths:
            self._accessed(paths)
        return out

    def _accessed(self, paths: list[str]) -> None:
        now = int(self.clock())
        seen = frecency.scores(self.spark.createDataFrame([(p, "result", now) for p in paths], "path string, kind string, ts long"), now)
        old = self.store.read("frecency", SCORES)
        aged = old.select("path", (F.col("score") * frecency.decay(F.lit(now) - F.col("last_access_secs"), frecency.HALF_LIFE)).alias("score"), F.lit(now).cast("long").alias("last_access_secs"), "result_count", "select_count")
        both = aged.unionByName(seen).groupBy("path").agg(F.sum("score").alias("score"), F.max("last_access_secs").alias("last_access_secs"), F.sum("result_count").alias("result_count"), F.sum("select_count").alias("select_count"))
        self.store.write("frecency", both)

    def find_files(self, query: str, limit: int, force_refresh: bool) -> dict:
        return self._found(SearchRequest(pattern=query, kind="path"), limit, force_refresh)

    def search_content(self, query: str, mode: str, limit: int, force_refresh: bool) -> dict:
        return self._found(SearchRequest(pattern=query, kind=mode), limit, force_refresh)

    def search_path_and_content(self, path_query: str, content_query: str, mode: str, limit: int, force_refresh: bool) -> dict:
        glob = any(c in path_query for c in "*?[{")
        where = {"globs": (path_query,)} if glob else {"path_substrings": (path_query,)}
        return self._found(SearchRequest(pattern=content_query, kind=mode, **where), limit, force_refresh)

    def context_pack(self, goal: str, intent: str, budget_tokens: int, max_files: int, changed_files: list[str] = ()) -> dict:
        return pack.pack(self._index(), goal, intent, budget_tokens, max_files, tuple(changed_files))

    # the index

    def index_status(self) -> dict:
        meta = ix.metadata(self.spark, f"{self.root}/index")
        if meta is None:
            return {"exists": False, "healthy": False}
        return {"exists": True, "healthy": True, "delta": meta["segments"] > 1} | meta | {"generation": self._generation()}

    def reindex(self, mode: str) -> dict:
        path, scan, number = f"{self.root}/index", self.scan(), self._generation() + 1
        journal = lambda paths: self.store.append("journal", paths.select(F.lit(number).cast("long").alias("generation"), F.col("relative_path").alias("path")))
        if mode == "full" or ix.metadata(self.spark, path) is None:
            journal(scan)
            return {"mode": "full"} | ix.build(scan, path, now=int(self.clock()))
        journal(ix.classify_changes(self._index().docs, scan).where("change != 'same'"))  # before the index changes
        return {"mode": "incremental"} | ix.apply_changes(self.spark, path, scan, now=int(self.clock()))

    # what sessions have read

    def observe(self, session_id: str, event: str, path: str | None = None, content_hash: str | None = None, tokens: int | None = None) -> None:
        """An event of a session (read, edit, pre_compact, session_start, session_end)."""
        now = self.clock()
        row = self.spark.createDataFrame([(session_id, int(now * 1000), now, event, path, content_hash, tokens)], "session_id string, seq long, at double, event string, path string, content_hash string, tokens long")
        self.store.append("events", row.select("session_id", "seq", F.timestamp_seconds("at").alias("ts"), "event", "path", "content_hash", "tokens"))

    def _checked_files(self, session: str, files: list[str]) -> DataFrame:
        """The files asked for; the scan is filtered, so a tree reads no others."""
        events = self.store.read_log("events", EVENTS).where((F.col("session_id") == session) & (F.col("path").isNull() | F.col("path").isin(files)))
        disk = self.scan().where(F.col("relative_path").isin(files)).select(F.col("relative_path").alias("path"), F.col("hash").alias("disk_hash"), F.ceil(F.col("size") / F.lit(3.5)).alias("disk_tokens"))
        return memo.check(memo.tracked(events), disk)

    def memo_status(self, files: list[str], session_id: str | None = None) -> list[dict]:
        rows = {r["path"]: r.asDict() for r in self._checked_files(self._session(session_id), files).collect()}  # the files asked for
        return [rows.get(f, {"path": f, "status": "unknown", "recommendation": "reread"}) for f in files]

    def memo_check(self, path: str, session_id: str | None = None) -> dict:
        session = self._session(session_id)
        self._record(session, "memo_check", {"path": path})
        return self.memo_status([path], session)[0]

    def memo_session(self, session_id: str | None = None) -> dict:
        session = self._session(session_id)
        events = self.store.read_log("events", EVENTS).where(F.col("session_id") == session)
        total = memo.totals(events).groupBy("session_id").agg(*[F.sum(c).alias(c) for c in ("total_reads", "redundant_reads_prevented", "tokens_saved", "compaction_count")]).first()
        return {"session_id": session, "tracked_files": memo.tracked(events).count()} | ({k: v for k, v in total.asDict().items() if k != "session_id"} if total else {})

    # portable sessions

    def _session(self, given: str | None) -> str:
        """The session asked for, the current one, the newest open one or the default."""
        if given or self.session:
            return given or self.session
        newest = sessions.newest_open(self.store.read("sessions", SESSIONS)).first()
        return newest["session_id"] if newest else "default"

    def _record(self, session: str, kind: str, payload: dict) -> None:
        number = int(self.store.read_log("log", LOG).agg(F.coalesce(F.max("entry_id"), F.lit(0))).first()[0]) + 1
        self.store.append("log", self.spark.createDataFrame([(number, session, int(self.clock()), kind, json.dumps(payload))], LOG))

    def session_open(self, goal: str, session_id: str | None = None) -> dict:
        self.session = session_id or f"session_{uuid.uuid4().hex[:12]}"
        opened = self.spark.createDataFrame([(self.session, goal)], "session_id string, goal string")
        self.store.write("sessions", sessions.upsert(self.store.read("sessions", SESSIONS), opened, int(self.clock())).selectExpr("session_id", "goal", "status", "cast(created_at as long) created_at", "cast(updated_at as long) updated_at"))
        return self.session_status(self.session)

    def session_status(self, session_id: str | None = None) -> dict:
        session = self._session(session_id)
        row = self.store.read("sessions", SESSIONS).where(F.col("session_id") == session).first()
        if row is None:
            raise ToolError("INVALID_QUERY", f"unknown session {session}")
        return row.asDict() | {"actions": self.store.read_log("log", LOG).where(F.col("session_id") == session).count()}

    def session_list(self, after: int = 0) -> list[dict]:
        """PAGE sessions from number ``after`` on, the newest first."""
        return [r.asDict() for r in self.store.read("sessions", SESSIONS).orderBy(F.desc("updated_at"), "session_id").offset(after).limit(PAGE).collect()]

    def session_close(self, status: str, session_id: str | None = None) -> dict:
        session = self._session(session_id)
        self.session_status(session)
        closed = sessions.close(self.store.read("sessions", SESSIONS), [session], int(self.clock()))
        closed = closed.withColumn("status", F.when(F.col("session_id") == session, status).otherwise(F.col("status"))).withColumn("updated_at", F.col("updated_at").cast("long"))
        self.store.write("sessions", closed)
        self.session = None if self.session == session else self.session
        return self.session_status(session)

    def session_snapshot(self, session_id: str | None = None, source_harness: str | None = None, source_model: str | None = None, pinned_snippet_paths: list[dict] = ()) -> dict:
        """Files read, searches run, pinned snippets and git's state, the entry that lists the snapshot last."""
        session, now = self._session(session_id), int(self.clock())
        name, state = f"snap_{uuid.uuid4().hex[:12]}", git.state(self.tree) if self.tree else git.GitState()
        log = self.store.read_log("log", LOG).where(F.col("session_id") == session)
        pins = self.spark.createDataFrame([(p["path"], p["line_start"], p["line_end"]) for p in pinned_snippet_paths], "path string, line_start int, line_end int")
        pinned = sessions.pinned_snippets(pins, self._index().docs) if pinned_snippet_paths else None
        if pinned is not None:
            self.store.write(f"snapshots/{name}/pinned", pinned)
            pinned = pinned.select(F.lit(session).alias("session_id"), "path", "sha", F.lit(now).cast("long").alias("last_read_at")).dropDuplicates(["path"])
        self.store.write(f"snapshots/{name}/files", sessions.files_read(log, pinned))
        self.store.write(f"snapshots/{name}/searches", sessions.searches_run(log))
        self.store.write(f"snapshots/{name}/log", log)
        harness = sessions.normalize_harness(source_harness) if source_harness else None
        self.store.append("snapshots_made", self.spark.createDataFrame([(name, session, now, harness, source_model, state.commit, state.dirty_files, state.hunk_summary)], SNAPSHOTS))
        return self.session_snapshot_get(name)

    def session_snapshot_list(self, session_id: str | None = None, after: int = 0) -> list[dict]:
        """PAGE snapshots from number ``after`` on, the newest first."""
        made = self.store.read_log("snapshots_made", SNAPSHOTS)
        made = made.where(F.col("session_id") == session_id) if session_id else made
        return [r.asDict() for r in made.orderBy(F.desc("created_at"), "snapshot_id").offset(after).limit(PAGE).collect()]

    def session_snapshot_get(self, snapshot_id: str) -> dict:
        row = self.store.read_log("snapshots_made", SNAPSHOTS).where(F.col("snapshot_id") == snapshot_id).first()
        if row is None:
            raise ToolError("INVALID_QUERY", f"unknown snapshot {snapshot_id}")
        count = {n: self.store.read(f"snapshots/{snapshot_id}/{n}", s).count() for n, s in (("files", FILES), ("searches", RAN), ("log", LOG))}
        return row.asDict() | count

    def _snapshot(self, snapshot_id: str) -> tuple[DataFrame, DataFrame]:
        self.session_snapshot_get(snapshot_id)
        return self.store.read(f"snapshots/{snapshot_id}/files", FILES), self.store.read(f"snapshots/{snapshot_id}/searches", RAN)

    def session_snapshot_diff(self, snapshot_a: str, snapshot_b: str, after: int = 0) -> dict:
        """PAGE differences of each kind from number ``after`` on."""
        (files_a, searches_a), (files_b, searches_b) = self._snapshot(snapshot_a), self._snapshot(snapshot_b)
        rows = lambda d: [r.asDict() for r in d.orderBy("change", d.columns[0]).offset(after).limit(PAGE).collect()]
        return {"files": rows(sessions.diff_files(files_a, files_b)), "searches": rows(sessions.diff_searches(searches_a, searches_b))}

    def session_resume(self, snapshot_id: str, budget_tokens: int = 3000) -> dict:
        files, searches = self._snapshot(snapshot_id)
        now = int(self.clock())
        scores = self.store.read("frecency", SCORES)
        found = sessions.resume(files, self.scan(), scores, scores.select("path", "score"), now)
        text = sessions.hydration(files, searches, snapshot_id, budget_tokens).first()
        paths = lambda d: [r["path"] for r in d.select("path").orderBy("path").limit(env.HARD_LIMIT).collect()]
        return {"snapshot_id": snapshot_id, "primed": paths(found["primed"]), "stale": paths(found["stale"]), "payload": text["payload"], "token_estimate": text["token_estimate"]}

    def session_handoff(self, target_harness: str, session_id: str | None = None, source_harness: str | None = None) -> dict:
        """A snapshot of the session, its brief, and the block to paste into the other harness."""
        try:
            target = sessions.normalize_harness(target_harness)
            source = sessions.normalize_harness(source_harness) if source_harness else None
        except ValueError as e:
            raise ToolError("INVALID_QUERY", str(e)) from e
        session = self._session(session_id)
        made = self.session_snapshot(session, source)
        log = self.store.read_log("log", LOG).where(F.col("session_id") == session)
        brief = sessions.brief(log)
        place = f"snapshots/{made['snapshot_id']}/brief"
        self.store.write(place, brief)
        return {"snapshot_id": made["snapshot_id"], "brief": brief.first()["markdown"], "block": sessions.handoff_block(source, target, session, made["snapshot_id"], f"{self.store.root}/{place}")}


__all__ = ["SCHEMAS", "ToolError", "Workspace", "checked"]
