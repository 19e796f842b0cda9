"""Traces: reading them, and the replay against one call after the other."""

import hashlib
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from loomdex.operators import replay
from loomdex.sources import traces

SCHEMA = "run_id string, turn long, name string, input string, answer string, text string, cwd string"


def _plain(calls, compact_at):
    """One run's calls in order, a dictionary as the disk and another as the memo."""
    disk, memo, known, edited, old = {}, {}, {}, set(), set()
    out = dict.fromkeys(("total_reads", "redundant_reads_prevented", "false_negatives", "post_compact_false_negatives", "actual_navigation_tokens", "memo_navigation_tokens", "memo_eligible_redundant_tokens"), 0)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    last = {}
    for c in sorted(calls, key=lambda c: c["turn"]):
        given, answer = json.loads(c["input"]), json.loads(c["answer"] or "{}")
        path = given.get("file_path") or answer.get("file", answer).get("filePath")
        if c["name"] == "Bash":
            m = re.search(r"cat (?:-n )?(\S+)", given["command"])
            path = m and m[1].strip("'")
        if path:
            path = path.removeprefix("/w/")
        if c["name"] in ("Read", "Bash"):
            data = answer.get("file", {}).get("content") or answer.get("stdout") or c["text"] or ""
            if path and data:
                t = math.ceil(len(data.encode()) / 3.5)
                out["total_reads"] += 1
                out["actual_navigation_tokens"] += t
                disk.setdefault(path, data)
                h = sha(disk[path])
                fresh = memo.get(path) == h
                out["post_compact_false_negatives"] += path in old and fresh
                if path in known:
                    out["memo_eligible_redundant_tokens"] += t * (path not in edited)
                    out["false_negatives"] += fresh and h != known[path]
                    out["memo_navigation_tokens"] += 0 if fresh else t
                    edited.discard(path)
                else:
                    out["memo_navigation_tokens"] += t
                out["redundant_reads_prevented"] += fresh and last.get(path) == "read"
                memo[path], known[path], last[path] = h, h, "read"
                old.discard(path)
        elif path:
            if c["name"] == "Write":
                disk[path] = given.get("content") or ""
            elif path in disk:
                for e in given.get("edits") or [given]:
                    disk[path] = disk[path].replace(e["old_string"], e["new_string"], 1)
            if path in disk:
                known[path] = sha(disk[path])
                edited.add(path)
            last[path] = "edit"
        if c["turn"] == compact_at:
            old = set(known)
            memo, known, edited, last = {}, {}, set(), {}
    return out


def _calls(seed):
    r, out = random.Random(seed), []
    for turn in range(1, 121):
        path, text = f"/w/src/{r.randrange(5)}.py", r.choice(["abc abc\n", "héllo abc", "x" * 9, ""])
        name = r.choice(["Read", "Read", "Read", "Bash", "Edit", "MultiEdit", "Write", "Grep"])
        swap = lambda: {"old_string": r.choice(["abc", "x", "nothing"]), "new_string": r.choice(["abc", "y"])}
        given, answer, said = {"file_path": path}, None, None
        if name == "Read":
            given, answer = ({}, {"file": {"filePath": path, "content": text}}) if r.random() < 0.5 else (given, None)
            said = text if answer is None else None
        elif name == "Bash":
            given, answer = {"command": r.choice([f"cat -n '{path}'", f"ls {path}", f"cat {path} | wc"])}, {"stdout": text}
        elif name == "Edit":
            given |= swap()
        elif name == "MultiEdit":
            given["edits"] = [swap(), swap()]
        elif name == "Write":
            given["content"] = text or None
        out.append({"run_id": f"r{seed}", "turn": turn, "name": name, "input": json.dumps(given), "answer": json.dumps(answer) if answer else None, "text": said, "cwd": "/w"})
    return [c for c in out if c["name"] != "Grep"]


@pytest.mark.parametrize("compact_at", [None, 60])
def test_replay_equals_one_call_after_the_other(spark, compact_at):
    runs = {f"r{s}": _calls(s) for s in range(6)}
    table = spark.createDataFrame([c for calls in runs.values() for c in calls], SCHEMA).repartition(5)
    cuts = {k: compact_at if any(c["turn"] == compact_at for c in v) else None for k, v in runs.items()}
    if compact_at:  # cut where a call is, in every run
        cuts = {k: max(c["turn"] for c in v if c["turn"] <= compact_at) for k, v in runs.items()}
    cut = F.create_map(*[x for k, v in cuts.items() for x in (F.lit(k), F.lit(v).cast("long"))])[F.col("run_id")]
    found = {row.run_id: row.asDict() for row in replay.replay(table, cut).collect()}
    for run, calls in runs.items():
        want = _plain(calls, cuts[run])
        assert {k: found[run][k] for k in want} == want
        assert want["memo_eligible_redundant_tokens"] > 0 and want["false_negatives"] == 0


def test_calls_that_read_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert replay.replay(none).count() == 0
    rows = [("r", None, "Read", '{"file_path": "a"}', None, "text", None), ("r", 1, None, None, None, None, None), ("r", 2, "Read", "no json", None, "t", None), ("r", 3, "Read", '{"file_path": "/a"}', None, "", "/"), ("r", 4, "Edit", '{"file_path": "b", "old_string": "x", "new_string": "y"}', None, None, None), ("r", 5, "Read", '{"file_path": "/x/b"}', None, "12345678", None)]
    found = replay.replay_reads(spark.createDataFrame(rows, SCHEMA).withColumn("segment", F.lit(7)).withColumn("tokens", F.lit("t"))).collect()
    assert [(r.path, r.turn, r.tokens, r.memo_status, r.eligible) for r in found] == [("x/b", 5, 3, "unknown", False)]


def test_tool_calls_out_of_json_lines(spark, tmp_path):
    use = lambda i, name, given: {"type": "tool_use", "id": i, "name": name, "input": given}
    result = lambda i, content: {"type": "tool_result", "tool_use_id": i, "content": content}
    for run, text in (("a", "fn a() {}"), ("b", "fn b() {}")):
        records = [
            {"type": "summary", "summary": "none"},
            {"type": "assistant", "cwd": "/w", "message": {"content": [{"type": "text", "text": "I read"}, use("1", "Read", {"file_path": "/w/x.rs"}), use("2", "Bash", {"command": "head -n 3 y.rs"})]}},
            {"type": "user", "message": {"content": [result("1", text)]}, "toolUseResult": {"file": {"filePath": "/w/x.rs", "content": text}}},
            {"type": "user", "message": {"content": [result("2", [{"type": "text", "text": "one "}, {"type": "text", "text": "two"}])]}},
            {"type": "user", "message": {"content": "go on"}},
            {"type": "assistant", "cwd": "/w", "message": {"content": [use("3", "Read", {"file_path": "/w/x.rs"})]}},
            {"type": "user", "message": {"content": [result("3", text)]}},
        ]
        (tmp_path / f"{run}.jsonl").write_text("\n".join([*map(json.dumps, records), "{broken", ""]))
    calls = traces.tool_calls(spark, str(tmp_path))
    rows = calls.orderBy("run_id", "turn").collect()
    assert [(r.run_id[-7:], r.turn, r.name, r.text) for r in rows][:3] == [("a.jsonl", 1, "Read", "fn a() {}"), ("a.jsonl", 2, "Bash", "one two"), ("a.jsonl", 3, "Read", "fn a() {}")]
    assert rows[1].answer is None and json.loads(rows[0].answer)["file"]["content"] == "fn a() {}" and len(rows) == 6
    found = replay.replay(calls).collect()
    assert [(r.total_reads, r.redundant_reads_prevented, r.tokens_saved, r.memo_eligible_redundant_tokens) for r in found] == [(3, 1, 3, 3)] * 2


def test_running_sums_of_many_small_buckets(spark):
    from loomdex.functions.running import running_sum
    from loomdex.operators import frecency

    r = random.Random(3)
    rows = [(i, r.choice([None, 1, 2, 3, 40, 41, 1000]), r.randrange(5)) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, b int, v int").repartition(3)
    found = {x.i: x.s for x in running_sum(df, F.col("b"), ["i"], F.col("v"), "s", coarse=F.floor(F.col("__k") / 10)).collect()}
    total = 0
    for i, _, v in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[0])):
        total += v
        assert found[i] == total
    hits = spark.createDataFrame([(f"p{i % 90}", 200_000 - 700 * i) for i in range(280)], "path string, ordinal int")
    scores = {f"p{i}": r.choice([1e-9, 0.5, 0.50001, 3.0, 1e6, 2.0**-700]) for i in range(60)}
    current = spark.createDataFrame(list(scores.items()), "path string, score double")
    got = [(x.path, x.ordinal) for x in frecency.rerank(hits, current).orderBy("new_rank").collect()]
    assert got == sorted(((x.path, x.ordinal) for x in hits.collect()), key=lambda x: (-scores.get(x[0], 0), x[1]))
