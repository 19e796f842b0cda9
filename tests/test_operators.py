import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomdex.functions import text
from loomdex.operators import analytics, envelope, frecency, index as ix, memo, pack, reuse, search as se, sessions
from loomdex.plans import seeds
from loomdex.plans.request import SearchRequest
from loomdex.sources import tree
from loomdex.streaming import changes

DOCS = [
    (1, "src/auth/router.rs", "pub struct WidgetBuilder;\npub fn new_widget() -> WidgetBuilder { panic!() }\n"),
    (2, "src/main.rs", "fn main() { println!(\"hello\"); }\r\n\r\nlast"),
    (3, "tests/auth_test.rs", "\n  auth works\n"),
    (4, "README.md", "é foo\n😀abc foo"),
    (5, "empty.txt", ""),
    (6, "null.txt", None),
]


def docs(spark, rows=DOCS):
    d = spark.createDataFrame(rows, "doc_id long, relative_path string, contents string")
    return d.select("doc_id", "relative_path", F.element_at(F.split("relative_path", "/"), -1).alias("file_name"), F.regexp_extract("relative_path", r"\.([^.]+)$", 1).alias("extension"), F.octet_length("contents").cast("long").alias("size"), "contents")


def live(spark, rows=DOCS):
    from loomdex.functions.trigrams import postings

    d = docs(spark, rows).cache()
    return ix.Index(d, postings(d).cache())


def test_lines_and_columns(spark):
    got = {r[0]: r[1] for r in docs(spark).select("doc_id", text.lines(F.col("contents"))).collect()}
    assert got[2] == ["fn main() { println!(\"hello\"); }", "", "last"] and got[5] == [] and got[3] == ["", "  auth works"] and got[6] is None
    hits = {(r[0], r[1]): r[2] for r in se.search(live(spark), SearchRequest(pattern="foo")).select("relative_path", "line_number", "column").collect()}
    assert hits == {("README.md", 1): 4, ("README.md", 2): 9}
    zero = se.search(live(spark), SearchRequest(pattern="x*", kind="regex")).where("relative_path = 'README.md'").select("column").distinct().collect()
    assert [r[0] for r in zero] == [1]


def test_index_equals_scan(spark):
    i = live(spark)
    requests = [SearchRequest(pattern=p, kind="regex") for p in ("(foo)?abc", "foo|ab", r"\x41|auth", "Widget.*panic", r"\bfn\b", "(?:wor)ks")]
    requests += [SearchRequest(pattern=p, case=c) for p in ("WidgetBuilder", "WIDGET", "é foo", "o") for c in ("sensitive", "insensitive")]
    for r in requests:
        a, b = (sorted(map(tuple, se.search(i, r, e).collect())) for e in ("indexed", "direct_scan"))
        assert a == b, r


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["abc", "foo", "a", ".", "(foo)?", "[ab]", "x|y", "é", "auth"]), min_size=1, max_size=4))
def test_index_equals_scan_on_random_patterns(spark, parts):
    i, r = live(spark), SearchRequest(pattern="".join(parts), kind="regex")
    assert sorted(map(tuple, se.search(i, r, "indexed").collect())) == sorted(map(tuple, se.search(i, r, "direct_scan").collect()))


JAVA_ONLY = [r"[a-z&&[^b]]xyz", r"[a[bc]]xyz", r"\0101abcd", r"\Qa.b\E", r"abcd\z", r"\p{Lu}bcd", r"(?x) a b c d", r"a(?i)BCD", r"x{2}yz+", r"\R?abcd", r"[^\W\d]+xyz"]


def test_seeds_of_java_syntax(spark):
    """Index and scan agree where Java and Python read a pattern differently, and on generated ones."""
    import random

    rnd = random.Random(4)
    atom = lambda: rnd.choice(["abc", "xyz", "bcd", ".", "[a-c]", "[a[b]]", "[x&&[^y]]", r"\w", r"\0141", r"\x61", "é", "(?:abc|xyz)", "(bcd)?", r"\Qabc\E", "(?i:ABC)", r"\babc", "z{2}", "a++", "&", "-"])
    patterns = JAVA_ONLY + ["".join(atom() for _ in range(rnd.randint(1, 4))) for _ in range(1000)]
    words = ["axyz", "Aabcd", "a.b", "abcd", "Xbcd", "aBCD", "xxyzz", "éxyz", "abcxyz", "bcd", "ABCxyz", "a&abc-xyz", "zzabc", "aaxyzbcd", "bxyz", "q\rabc", "abc\u2028xyz"]
    texts = words + [a + rnd.choice(["", " ", "&", "-"]) + b for a in words for b in words]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").toPandas()
    jvm = spark._jvm.java.util.regex.Pattern
    grams = {i: t.encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))) for i, t in zip(rows["doc_id"], rows["text"])}

    def meets(condition, raw):
        if condition is None:
            return True
        return condition in raw if isinstance(condition, bytes) else (all if condition[0] == "and" else any)(meets(c, raw) for c in condition[1])

    pruned = 0
    for p in patterns:
        found = seeds.of_regex(p)
        if found is None:
            continue
        pruned += 1
        java = jvm.compile(se.DIALECT + "(?:" + p + ")")
        for i, t in zip(rows["doc_id"], rows["text"]):
            if not meets(found, grams[i]):
                assert not java.matcher(t).find(), (p, t)
        if pruned > 120:
            break
    assert pruned > 50 and all(seeds.of_regex(p) is None for p in JAVA_ONLY[:8])


def test_dialect(spark):
    i = live(spark, [(1, "a", "bz\rqq"), (2, "b", "caf\u00e9s x"), (3, "c", "x\u2028y"), (4, "d", "K and \u212a")])
    found = lambda p, **k: sorted(r[0] for r in se.search(i, SearchRequest(pattern=p, kind="regex", **k)).collect())
    assert found("bz.qq") == ["a"] and found("x.y") == ["c"] and found(r"caf\b") == [] and found(r"^\w+ x$") == ["b"]
    assert found("^k AND", case="insensitive") == ["d"] and found("\u212a", case="insensitive") == ["d"] and found("zk", case="insensitive") == []


def test_index_on_disk(spark, tmp_path):
    """Pages of the documents are pruned, probes lose nothing, changes become a delta or a rebuild."""
    rows = [(n, f"d{n % 7}/f{n:04}.txt", f"common text number{n:05} " + "filler words here " * 40 + ("needle" if n % 500 == 3 else "")) for n in range(2000)]
    given = docs(spark, rows).withColumns({"modified_unix_secs": F.lit(0).cast("long"), "hash": text.sha256(F.col("contents"))})
    path = str(tmp_path / "index")
    meta = ix.build(given.repartition(3), path, now=5)
    assert (meta["docs"], meta["built_secs"]) == (2000, 5) and meta["postings"] > 2000
    i = ix.load(spark, path)
    for r in (SearchRequest(pattern="needle"), SearchRequest(pattern="number00777"), SearchRequest(pattern="common"), SearchRequest(pattern="zzzz"), SearchRequest(pattern="needle|number00001", kind="regex")):
        assert sorted(map(tuple, se.search(i, r, "indexed").collect())) == sorted(map(tuple, se.search(i, r, "direct_scan").collect())), r
    some = given.withColumn("contents", F.when(F.col("doc_id") == 5, "replaced needle").otherwise(F.col("contents"))).withColumn("hash", text.sha256(F.col("contents"))).where("doc_id != 3")
    assert not ix.apply_changes(spark, path, some)["rebuild"]
    live_ = ix.load_current(spark, path)
    assert sorted(r[0] for r in se.search(live_, SearchRequest(pattern="needle")).collect()) == ["d2/f1003.txt", "d5/f0005.txt", "d5/f1503.txt", "d6/f0503.txt"]
    assert live_.postings.where("doc_id = 5").count() == len(ix.trigrams_of("replaced needle"))
    many = some.withColumn("contents", F.concat("contents", F.lit(" more"))).withColumn("hash", text.sha256(F.col("contents")))
    assert ix.apply_changes(spark, path, many)["rebuild"] and ix.load_current(spark, path).ranged
    assert se.search(ix.load_current(spark, path), SearchRequest(pattern="here  more")).count() + se.search(ix.load_current(spark, path), SearchRequest(pattern="needle more")).count() == 1999


def test_limits_and_envelope(spark):
    i = live(spark, [(n, f"f{n:02}.txt", "needle\nneedle\n") for n in range(20)])
    assert se.search(i, SearchRequest(pattern="needle", max_results=1)).count() == 1
    assert se.search(i, SearchRequest(pattern="needle", max_results=1, limit_mode="per_file")).count() == 20
    e = envelope.envelope(i, SearchRequest(pattern="needle"), 5)
    assert len(e["results"]) == 5 and e["truncated"] and e["counts"]["total_line_matches"] == 40
    assert not envelope.envelope(i, SearchRequest(pattern="needle"), 40)["truncated"]


def test_tree(spark, tmp_path):
    files = {"src/lib.rs": b"x", "ignored.txt": b"y", ".gitignore": b"ignored.txt\n", ".github/workflows/ci.yml": b"z", ".venv/secret.txt": b"s", "vendor/swagger.pb": b"\xff\xfe\x00\x01sideEffects", "latin.txt": b"caf\xe9 au lait, plain text otherwise, long enough"}
    for p, c in files.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(c)
    got = tree.scan_tree(spark, str(tmp_path))
    rows = {r["relative_path"]: r for r in got.collect()}
    assert set(rows) == {"src/lib.rs", ".gitignore", ".github/workflows/ci.yml", "vendor/swagger.pb", "latin.txt"}
    assert rows["vendor/swagger.pb"]["skipped_binary"] and not rows["latin.txt"]["skipped_binary"] and rows["src/lib.rs"]["extension"] == "rs" and rows[".gitignore"]["extension"] is None
    s = tree.repo_stats(got).first()
    assert (s["tracked_files"], s["searchable_files"], s["skipped_binary_files"]) == (5, 4, 1)


def test_change_log(spark):
    log = spark.createDataFrame([(1, "a", False, 1), (2, "b", False, 2), (3, "a", True, None), (4, "b", False, 3)], "batch int, relative_path string, deleted boolean, doc_id int")
    delta, removed = ix.latest(log)
    assert [tuple(r) for r in delta.collect()] == [("b", 3)] and [r[0] for r in removed.collect()] == ["a"]


def test_frecency(spark):
    a = spark.createDataFrame([("x", "result", 0), ("x", "select", 604800), ("y", "result", 604800)], "path string, kind string, ts long")
    s = {r["path"]: r["score"] for r in frecency.scores(a, 604800).collect()}
    assert s == {"x": 3.5, "y": 1.0}
    saved = spark.createDataFrame([("x", 1.0), ("z", 2.0)], "path string, score double")
    r = {x["path"]: (x["score"], x["last_access_secs"]) for x in frecency.restore(frecency.scores(a, 604800), saved, 700000).collect()}
    assert r == {"x": (3.5, 700000), "y": (1.0, 604800), "z": (2.0, 700000)}


def events(spark, rows):
    t0 = dt.datetime(2024, 1, 1)
    full = [(s, i, t0 + dt.timedelta(seconds=t), e, p, h, k) for i, (s, t, e, p, h, k) in enumerate(rows)]
    return spark.createDataFrame(full, "session_id long, seq long, ts timestamp, event string, path string, content_hash long, tokens long")


def test_memo(spark):
    rows = [(1, 0, "read", "a", 1, 100), (1, 1, "read", "a", 1, 0), (1, 2, "edit", "a", None, None), (1, 3, "read", "a", 2, 50), (1, 4, "pre_compact", None, None, None), (1, 5, "read", "a", 2, 10), (1, 6, "read", "a", 2, 30), (2, 7, "read", "a", 1, 5), (1, 2000, "read", "a", 2, 1)]
    got = {(r["session_id"], r["life"]): tuple(r)[2:] for r in memo.totals(events(spark, rows)).collect()}
    assert got == {(1, 0): (5, 2, 130, 1), (2, 0): (1, 0, 0, 0), (1, 1): (1, 0, 0, 0)}
    disk = spark.createDataFrame([("a", 9, 110)], "path string, disk_hash long, disk_tokens long")
    files = spark.createDataFrame([(1, "a", 1, 100), (1, "b", 1, 5), (2, "a", 9, 100)], "session_id long, path string, content_hash long, tokens long")
    r = {(x["session_id"], x["path"]): x["recommendation"] for x in memo.check(files, disk).collect()}
    assert r == {(1, "a"): "reread", (1, "b"): "reread", (2, "a"): "skip_reread"}


def test_reuse(spark):
    j = spark.createDataFrame([(11, "docs/guide.md")], "generation long, path string")
    q = lambda *r: spark.createDataFrame(r, "request_id int, recorded_generation long, recorded_epoch long, matched_paths array<string>")
    scope = F.col("path").startswith("src/")
    check = lambda qs, jj, g: {r["request_id"]: (r["fresh"], r["reason"]) for r in reuse.check(qs, jj, F.lit(g), F.lit(1), scope).collect()}
    assert check(q((1, 10, 1, ["src/lib.rs"]), (2, 10, 2, []), (3, 12, 1, []), (4, 11, 1, []), (5, 8, 1, [])), j, 11) == {1: (True, "unchanged"), 2: (False, "context_invalidated"), 3: (False, "generation_reset"), 4: (True, "unchanged"), 5: (False, "journal_overflow")}
    k = spark.createDataFrame([(11, "src/lib.rs")], "generation long, path string")
    assert check(q((1, 10, 1, ["src/lib.rs"]), (2, 10, 1, ["x"])), k, 11) == {1: (False, "changed_matched_path"), 2: (False, "changed_search_scope")}


def test_search_memo(spark):
    rows = [("s", 1, "a"), ("s", 2, "b"), ("s", 3, "c"), ("s", 4, "a"), ("t", 9, "b")]
    got = reuse.search_memo(spark.createDataFrame(rows, "session_id string, seq long, key string"), 2).collect()
    assert sorted(map(tuple, got)) == [("s", "search-000001", "a", 4), ("s", "search-000003", "c", 3), ("t", "search-000001", "b", 9)]


def test_pack(spark):
    p = pack.pack(live(spark), "fix auth panic for service accounts", max_files=3)
    assert p["items"][0]["path"] == "src/auth/router.rs" and len(p["items"]) <= 3
    assert pack.goal_terms("Fix the auth panic for auth service accounts") == ["auth", "panic", "service", "accounts"]


def test_sessions(spark, tmp_path):
    log = spark.createDataFrame([(1, "s", 5, "read", '{"path":"a","sha":"x"}'), (2, "s", 6, "read", '{"path":"a","sha":"y"}'), (3, "s", 7, "search", '{"pattern":"q","result_paths":["a","b"]}')], "entry_id long, session_id string, ts long, kind string, payload string")
    assert [tuple(r) for r in sessions.files_read(log).collect()] == [("s", "a", "x", 5)]
    s = sessions.searches_run(log).first()
    assert (s["search_id"], s["query"], s["search_kind"], s["result_paths"]) == ("action-3", "q", "search", ["a", "b"])
    more = sessions.record(log, spark.createDataFrame([("s", 9, 1, "read", "{}")], "session_id string, ts long, seq int, kind string, payload string"))
    assert more.agg(F.max("entry_id")).first()[0] == 4
    b = sessions.brief(log)
    assert sessions.brief_problems(b, log).count() == 0
    assert sessions.brief_problems(b, log.where("entry_id > 1")).first()[0] == "unknown citation 1"
    files = sessions.files_read(log)
    sessions.write_snapshot(files, sessions.searches_run(log), log, str(tmp_path), "one")
    h = sessions.hydration(files, sessions.searches_run(log), "one").first()
    assert "- a (x)" in h["payload"] and h["token_estimate"] > 10
    table = spark.createDataFrame([("s", "g", "closed", 1, 1)], "session_id string, goal string, status string, created_at int, updated_at int")
    got = {r["session_id"]: tuple(r)[1:] for r in sessions.upsert(table, spark.createDataFrame([("s", " "), ("t", "h")], "session_id string, goal string"), 9).collect()}
    assert got == {"s": ("g", "open", 1, 9), "t": ("h", "open", 9, 9)}
    assert sessions.import_id("a", ["a", "a-1"]) == "a-2" and sessions.normalize_harness("Claude-Code") == "claude_code"


def test_metrics(spark):
    r = spark.createDataFrame([("s", 1, "h"), ("s", 2, "r"), ("s", 3, "b")], "scenario string, rank int, path string")
    o = spark.createDataFrame([("s", "h", "helpful"), ("s", "r", "required"), ("s", "b", "bad")], "scenario string, path string, label string")
    m = analytics.retrieval(r, o).first()
    assert (m["hit_at_1"], m["hit_at_4"], m["mrr"], round(m["precision"], 4), m["misleading_top1"]) == (False, True, 0.5, 0.6667, False)
    v = spark.createDataFrame([(float(i),) for i in range(1, 5)], "v double").agg(F.sort_array(F.collect_list("v")).alias("a"))
    assert v.select(analytics.percentile(F.col("a"), 0.5)).first()[0] == 3.0


def test_changes(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", "changed", t), ("a", "deleted", t + dt.timedelta(milliseconds=300)), ("a", "changed", t + dt.timedelta(seconds=5))]
    got = changes.coalesce(spark.createDataFrame(rows, "path string, kind string, ts timestamp")).orderBy("batch").collect()
    assert [(r["deleted"], r["events"]) for r in got] == [(True, 2), (False, 1)]


def test_queries_have_results(spark, sf):
    from loomdex.queries import QUERIES

    for name in ("literal_search", "memo_stream", "memo_session_totals", "context_pack_budget", "index_overlay_search"):
        assert QUERIES[name](spark, sf).columns


def test_memo_broadcast_sends_every_edit(spark, sf):
    from loomdex import queries
    from loomdex.sources import corpora

    e = corpora.memo_events(spark, sf)
    edited = {r["path"] for r in e.where("event = 'edit'").select("path").collect()}
    want = sorted((r["session_id"], r["path"]) for r in memo.tracked(e, 30 * 86400).select("session_id", "path").collect() if r["path"] in edited)
    assert sorted((r["session_id"], r["path"]) for r in queries.memo_broadcast(spark, sf).collect()) == want and want


def test_tools(spark, tmp_path):
    """The tool surface end to end: indexing, searching, reuse, sessions, snapshots, handoff."""
    from loomdex.operators.tools import SCHEMAS, Workspace

    tree_ = tmp_path / "tree"
    (tree_ / "src").mkdir(parents=True)
    (tree_ / "src" / "a.rs").write_text("fn alpha() {}\nneedle\n")
    (tree_ / "src" / "b.rs").write_text("fn beta() {}\n")

    def scan():
        found = tree.scan_tree(spark, str(tree_))
        return found.withColumn("doc_id", F.xxhash64("relative_path"))

    w = Workspace(spark, str(tmp_path / "work"), scan, clock=lambda: 1000.0)
    assert len(SCHEMAS) == 19 and all(hasattr(w, n) for n in SCHEMAS)
    code = lambda r: r["error"]["code"]
    assert code(w.call("nope")) == "INVALID_QUERY" and code(w.call("find_files")) == "INVALID_QUERY" and code(w.call("find_files", {"query": "a", "limit": 0})) == "INVALID_QUERY"
    assert code(w.call("find_files", {"query": "a", "x": 1})) == "INVALID_QUERY" and code(w.call("search_content", {"query": "a", "mode": "glob"})) == "INVALID_QUERY"
    assert code(w.call("search_content", {"query": "alpha"})) == "INDEX_UNAVAILABLE"
    assert w.call("index_status")["result"] == {"exists": False, "healthy": False}
    assert w.call("reindex")["result"]["docs"] == 2
    w.call("session_open", {"session_id": "s1", "goal": "g"})
    found = w.call("search_content", {"query": "needle"})["result"]
    assert [r["relative_path"] for r in found["results"]] == ["src/a.rs"] and not found["reused"]
    assert w.call("search_content", {"query": "needle"})["result"]["reused"]
    assert not w.call("search_content", {"query": "needle", "force_refresh": True})["result"]["reused"]
    (tree_ / "src" / "a.rs").write_text("fn alpha() {}\nneedle needle\n")
    assert w.call("reindex")["result"]["rebuild"] and not w.call("search_content", {"query": "needle"})["result"]["reused"]
    assert w.call("find_files", {"query": "B.RS"})["result"]["results"] == [{"relative_path": "src/b.rs"}]
    assert w.call("search_path_and_content", {"path_query": "src/*.rs", "content_query": "fn [ab]", "mode": "regex"})["result"]["counts"]["files_with_matches"] == 2
    assert w.call("context_pack", {"goal": "fix needle"})["result"]["items"][0]["path"] == "src/a.rs"
    disk = {r["relative_path"]: (r["hash"], r["size"]) for r in scan().collect()}
    w.observe("s1", "read", "src/b.rs", disk["src/b.rs"][0], 4)
    w.observe("s1", "read", "src/a.rs", "old", 9)
    status = w.call("memo_status", {"files": ["src/b.rs", "src/a.rs", "zz"]})["result"]
    assert [r["recommendation"] for r in status] == ["skip_reread", "reread_with_diff" if abs(-(-disk["src/a.rs"][1] * 2 // 7) - 9) < 0.9 else "reread", "reread"] and status[2]["status"] == "unknown"
    assert w.call("memo_check", {"path": "src/b.rs"})["result"]["status"] == "fresh" and w.call("memo_session")["result"]["total_reads"] == 2
    one = w.call("session_snapshot", {"pinned_snippet_paths": [{"path": "src/a.rs", "line_start": 1, "line_end": 1}], "source_harness": "claude"})["result"]
    w.call("search_content", {"query": "beta"})
    two = w.call("session_snapshot")["result"]
    assert one["source_harness"] == "claude_code" and two["searches"] == one["searches"] + 1
    diff = w.call("session_snapshot_diff", {"snapshot_a": one["snapshot_id"], "snapshot_b": two["snapshot_id"]})["result"]
    assert any(c["change"] == "added" for c in diff["searches"]) and {"path": "src/a.rs", "change": "removed"} in diff["files"]
    resumed = w.call("session_resume", {"snapshot_id": one["snapshot_id"], "budget_tokens": 1})["result"]
    assert "src/a.rs" in resumed["primed"] and resumed["token_estimate"] <= 140
    block = w.call("session_handoff", {"target_harness": "codex", "source_harness": "claude-code"})["result"]["block"]
    assert "In Codex, paste:" in block and "From: Claude" in block and code(w.call("session_handoff", {"target_harness": "vi"})) == "INVALID_QUERY"
    assert {s["snapshot_id"] for s in w.call("session_snapshot_list")["result"]} >= {one["snapshot_id"], two["snapshot_id"]}
    assert w.call("session_close", {"status": "abandoned"})["result"]["status"] == "abandoned" and [s["session_id"] for s in w.call("session_list")["result"]] == ["s1"]
    assert code(w.call("session_snapshot_get", {"snapshot_id": "none"})) == "INVALID_QUERY" and w.call("index_status")["result"]["generation"] == 2


def test_git_state(spark, tmp_path):
    import subprocess

    from loomdex.sources import git

    assert git.state(str(tmp_path / "none")) == git.GitState()
    run = lambda *a: subprocess.run(["git", *a], cwd=tmp_path, check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.txt").write_text("1\n2\n")
    run("add", ".")
    run("-c", "user.name=n", "-c", "user.email=e@e", "commit", "-q", "-m", "m")
    (tmp_path / "a.txt").write_text("1\n3\n4\n")
    s = git.state(str(tmp_path))
    assert len(s.commit) == 40 and s.dirty_files == ["a.txt"] and s.hunk_summary == {"a.txt": 3}
    rows = spark.createDataFrame([("3\t4\ta/b",), ("-\t-\timg",), ("junk",), ("1\t0\ta/b",)], "value string")
    assert {r["path"]: r["lines"] for r in git.changed_lines(rows).collect()} == {"a/b": 8, "img": 0}


def test_hydration_by_bytes(spark):
    files = spark.createDataFrame([("s", "é" * 700, "x", 1)], "session_id string, path string, sha string, last_read_at long")
    ran = spark.createDataFrame([], "session_id string, search_id string, query string, search_kind string, result_paths array<string>, entry_id long")
    for budget in (200, 201, 300):
        text_ = sessions.hydration(files, ran, "one", budget).first()["payload"]
        body = text_.removesuffix("\n\n[truncated to hydration budget]\n")
        assert body != text_ and budget * 4 - 4 < max(len(body.encode()), 509) <= max(budget * 4, 512)


def test_percentiles_exact(spark):
    import random

    rnd = random.Random(1)
    rows = [(g, v) for g, n in (("a", 3000), ("b", 1), ("c", 700), (None, 5)) for v in [rnd.choice([rnd.random(), 0.5]) for _ in range(n)]]
    got = analytics.percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()
    for r in got:
        v = sorted(x for g, x in rows if g == r["g"])
        at = lambda p: v[int(p * (len(v) - 1) + 0.5)]
        assert (r["p50"], r["p95"], r["p99"], r["min"], r["max"]) == (at(0.5), at(0.95), at(0.99), v[0], v[-1]) and abs(r["mean"] - sum(v) / len(v)) < 1e-9
    assert len(got) == 4


def test_scan_caps_excludes_and_one_file(spark, tmp_path):
    for p, c in {"big.txt": "x" * 100, "small.txt": "y", ".github/w.yml": "z" * 100, "_init.py": "q", "gone.log": "l", ".git/info/exclude": "*.log\n", "own.tmp": "t"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(c)
    rules = tmp_path.parent / f"{tmp_path.name}-global"
    rules.write_text("*.tmp\n")
    rows = {r["relative_path"]: r["contents"] for r in tree.scan_tree(spark, str(tmp_path), max_file_size=50, excludes=(str(rules),)).collect()}
    assert {k: v is None for k, v in rows.items()} == {"big.txt": True, "small.txt": False, ".github/w.yml": True, "_init.py": False}
    one = tree.scan_file(spark, str(tmp_path / "gone.log")).first()
    assert (one["relative_path"], bytes(one["contents"]), one["extension"]) == ("gone.log", b"l", "log")


def test_watch(spark, tmp_path):
    """Ticks bring an index up to date, and only what an index would hold counts."""
    import time

    from loomdex.streaming import watch

    tree_ = tmp_path / "tree"
    tree_.mkdir()
    for n in range(8):
        (tree_ / f"f{n}.txt").write_text(f"text number {n} here")
    scan = lambda: tree.scan_tree(spark, str(tree_)).withColumn("doc_id", F.xxhash64("relative_path"))
    path = str(tmp_path / "index")
    ix.build(scan(), path)
    (tree_ / "f3.txt").write_text("now it holds a needle")
    (tree_ / ".hidden").write_text("needle")
    told = []
    asked = []

    def read(paths):
        asked.append(sorted(r[0] for r in paths.collect()))
        return tree.scan_named(paths, str(tree_)).withColumn("doc_id", F.xxhash64("relative_path"))

    q = watch.watch(spark, lambda: tree.listing(spark, str(tree_)), read, path, str(tmp_path / "checkpoint"), told=lambda n, what: told.append(what)).start()
    try:
        until = time.time() + 90
        while not told and time.time() < until and q.isActive:
            time.sleep(0.5)
    finally:
        q.stop()
    assert told and told[0]["changed"] == 1 and told[0]["docs"] == 8 and asked[0] == ["f3.txt"]
    assert [r[0] for r in se.search(ix.load_current(spark, path), SearchRequest(pattern="needle")).select("relative_path").collect()] == ["f3.txt"]
    events = spark.createDataFrame([("a.rs", "created"), ("../x", "created"), ("idx/docs", "changed"), (".venv/y", "changed"), ("b.log", "deleted"), (".gitignore", "changed")], "path string, kind string")
    assert sorted(r["path"] for r in watch.relevant(events, "idx", [("", "*.log")]).collect()) == [".gitignore", "a.rs"]


def test_index_feed(spark, tmp_path):
    """Changes file by file: created, changed, deleted, renamed, late ones; a restart from the checkpoint."""
    from loomdex.streaming import changes, watch

    tree_ = tmp_path / "tree"
    tree_.mkdir()
    for n in range(6):
        (tree_ / f"f{n}.txt").write_text(f"text number {n} here")
    scan = tree.scan_tree(spark, str(tree_)).withColumn("doc_id", F.xxhash64("relative_path"))
    path, asked = str(tmp_path / "index"), []
    ix.build(scan, path)

    def read(paths):
        asked.append(sorted(r[0] for r in paths.collect()))
        return tree.scan_named(paths, str(tree_)).withColumn("doc_id", F.xxhash64("relative_path"))

    shape = "path string, kind string, new_path string, ts timestamp"

    def tell(*rows):
        made = spark.createDataFrame([(p, k, n, t) for p, k, n, t in rows], "path string, kind string, new_path string, ts double")
        made.withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        stream = changes.renames(spark.readStream.schema(shape).parquet(str(tmp_path / "events")))
        q = watch.index_feed(spark, stream, read, path, str(tmp_path / "checkpoint"), [("", "*.log")]).trigger(availableNow=True).start()
        q.awaitTermination()
        return [r[0] for r in se.search(ix.load(spark, path), SearchRequest(pattern="needle")).orderBy("relative_path").select("relative_path").collect()]

    (tree_ / "f3.txt").write_text("a needle")
    (tree_ / "new.txt").write_text("another needle")
    (tree_ / "f4.txt").rename(tree_ / "moved.txt")
    (tree_ / "f5.txt").unlink()
    (tree_ / "x.log").write_text("needle")
    rows = [("f3.txt", "changed", None, 1000.0), ("f3.txt", "changed", None, 1000.2), ("new.txt", "created", None, 1000.0), ("f4.txt", "renamed", "moved.txt", 1001.0), ("f5.txt", "deleted", None, 1001.0), ("x.log", "created", None, 1001.0)]
    assert tell(*rows) == ["f3.txt", "new.txt"] and asked == [["f3.txt", "moved.txt", "new.txt"]]
    assert {r[0] for r in ix.load(spark, path).docs.select("relative_path").collect()} == {"f0.txt", "f1.txt", "f2.txt", "f3.txt", "new.txt", "moved.txt"}
    (tree_ / "f1.txt").write_text("late needle")
    assert tell(("f1.txt", "changed", None, 10.0)) == ["f1.txt", "f3.txt", "new.txt"] and asked[1:] == [["f1.txt"]]  # an hour behind the newest
    (tree_ / "new.txt").unlink()
    assert tell(("new.txt", "deleted", None, 5000.0), ("new.txt", "created", None, 4000.0)) == ["f1.txt", "f3.txt"]


def test_late_events_count(spark, tmp_path):
    """Hours behind the newest, in a batch of their own: counted as they arrive."""
    from loomdex.streaming.memo import memo_totals

    shape, out = events(spark, [(1, 0, "read", "a", 1, 100)]).schema, []
    batches = [[(1, 9_000, "read", "a", 1, 100), (2, 9_000, "read", "b", 1, 7)], [(1, 100, "read", "a", 1, 0), (1, 50, "read", "c", 1, 3)]]
    for rows in batches:
        events(spark, rows).write.mode("append").parquet(str(tmp_path / "in"))
        q = memo_totals(spark.readStream.schema(shape).parquet(str(tmp_path / "in")), 60_000).writeStream.foreachBatch(lambda b, n: out.extend(tuple(r)[:6] for r in b.collect())).option("checkpointLocation", str(tmp_path / "checkpoint")).outputMode("update").trigger(availableNow=True).start()
        q.awaitTermination()
    assert (1, 0, 1, 0, 0, 0) in out and (1, 0, 3, 1, 100, 0) in out


def test_idle_sessions_start_anew_in_a_stream(spark, tmp_path):
    """A later batch after an idle gap, with a timer in between, is the session's next life."""
    from loomdex.streaming.memo import memo_totals

    first = events(spark, [(1, 0, "read", "a", 1, 100), (1, 1, "read", "a", 1, 0), (2, 0, "read", "b", 1, 7)])
    first.write.parquet(str(tmp_path / "in"))
    out, run = [], dict(checkpointLocation=str(tmp_path / "checkpoint"))

    def step():
        q = memo_totals(spark.readStream.schema(first.schema).parquet(str(tmp_path / "in")), 600).writeStream.foreachBatch(lambda b, n: out.append([tuple(r)[:6] for r in b.collect()])).options(**run).outputMode("update").trigger(availableNow=True).start()
        q.awaitTermination()

    step()
    events(spark, [(2, 90_000, "read", "b", 1, 7)]).write.mode("append").parquet(str(tmp_path / "in"))
    step()
    events(spark, [(1, 90_100, "read", "a", 1, 100), (2, 90_050, "read", "b", 1, 7)]).write.mode("append").parquet(str(tmp_path / "in"))
    step()
    rows = [r for batch in out for r in batch]
    assert (1, 0, 2, 1, 100, 0) in rows and (1, 1, 1, 0, 0, 0) in rows and (2, 1, 2, 1, 7, 0) in rows
