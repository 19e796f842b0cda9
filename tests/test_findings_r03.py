"""Whole counts of reused searches, and plans that neither shuffle nor sort whole tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from loomdex import oracle, queries
from loomdex.functions.trigrams import postings
from loomdex.operators import analytics, index as ix, pack, search as se, segments
from loomdex.operators.tools import Workspace
from loomdex.plans.request import SearchRequest
from test_blocks import _docs


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(se, "JOB_BYTES", 0)
    texts = ["quick station and\nnation of\nthe ration", "an element of the nation", "licensed quilt", "nothing of that"]
    ix.build(_docs(spark, 400, texts), str(tmp_path / "index"))
    return ix.load(spark, str(tmp_path / "index"))


def test_a_reused_search_tells_of_all_files_that_match(spark, tmp_path):
    scan = _docs(spark, 150, ["a license"]).withColumns({"modified_unix_secs": F.lit(0).cast("long"), "hash": F.lit("h")})
    w = Workspace(spark, str(tmp_path / "w"), lambda: scan, session_id="s", clock=lambda: 1.0)
    w.call("reindex", {"mode": "full"})
    first, again = (w.call("search_content", {"query": "license", "limit": 100})["result"] for _ in range(2))
    assert not first["reused"] and again["reused"] and len(again["paths"]) == 100
    assert first["counts"] == again["counts"] == {"files_with_matches": 150, "total_line_matches": 150, "matches_returned": 150}


def test_tool_search_reuse_is_its_sql_beyond_the_limit(spark, tmp_path):
    path = f"{tmp_path}/documents.parquet"
    duckdb.sql(f"COPY (SELECT i::BIGINT AS doc_id, 'src' || (i % 3 + 1) AS source, 'en' AS lang, 'under a license' || chr(10) || 'the license' AS text FROM range(480) t(i)) TO '{path}'")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{path}'")
    want = sorted(con.execute(oracle.SQL["tool_search_reuse"]).fetchall())
    assert max(r[2] for r in want) > 100
    assert sorted(map(tuple, queries.tool_search_reuse(spark, str(tmp_path)).collect())) == want


BATCH = {
    "all": SearchRequest(pattern="nation"), "short": SearchRequest(pattern="qu"), "capped": SearchRequest(pattern="tion", max_results=7),
    "per_file": SearchRequest(pattern="tion", max_results=2, limit_mode="per_file"), "none": SearchRequest(pattern="zzqqxx"),
}


@pytest.mark.parametrize("sent", [0, 10**6])
def test_a_batch_never_shuffles_texts(stored, monkeypatch, sent):
    monkeypatch.setattr(se, "SENT", sent)
    got = se.search_many(stored, BATCH)
    assert "SortMergeJoin" not in _plan(got)
    want = {(n, *r) for n, q in BATCH.items() for r in map(tuple, se.search(stored, q).collect())}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_a_search_of_very_many_candidates_shuffles_no_text(stored, monkeypatch):
    wanted = se.search(stored, SearchRequest(pattern="nation")).count()
    monkeypatch.setattr(se, "SENT", 0)
    monkeypatch.setattr(se, "COUNTED", 0)
    got = se.search(stored, SearchRequest(pattern="nation"))
    assert "Join" not in _plan(got) and got.count() == wanted == 200


def test_a_pack_shuffles_no_text(spark, tmp_path):
    docs = _docs(spark, 40, ["no such line"]).withColumn("relative_path", F.format_string("tests/unit%d.txt", "doc_id"))
    ix.build(docs, str(tmp_path / "index"))
    stored = ix.load(spark, str(tmp_path / "index"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as if no size were known to be small
    try:
        plan = _plan(pack.rank(stored, "unit tests"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    semi = [line for line in plan.split("\n") if "HashJoin" in line or "MergeJoin" in line]
    semi = [line for line in semi if "LeftSemi" in line]
    assert semi and all("BroadcastHashJoin" in line for line in semi)


def test_percentiles_sort_no_group_in_one_task(spark):
    samples = spark.range(0, 400_000, 1, 16).select((F.col("id") % 2).alias("g"), F.hash("id").cast("double").alias("v"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = analytics.percentiles(samples, ["g"], "v")
        got = {r["g"]: (r["p50"], r["p95"], r["p99"]) for r in out.collect()}
        plan = _plan(out).split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for g in (0, 1):
        v = sorted(r["v"] for r in samples.where(F.col("g") == g).collect())
        assert got[g] == tuple(v[int(p * (len(v) - 1) + 0.5)] for p in (0.5, 0.95, 0.99))
    rows = [line for line in plan.split("\n") if "Join" in line and "__k0_" in line]
    assert rows and all("__s#" in line for line in rows)  # a group is many keys of the join


@pytest.mark.parametrize("sent", [2, 10**6])
def test_a_merge_makes_no_row_for_a_pair(spark, tmp_path, monkeypatch, sent):
    """Blocks lose what is gone as they are, or, of more rows than can be sent, are extracted anew."""
    path, docs = str(tmp_path / "index"), _docs(spark, 300, ["some words", "and others", "the last of them"])
    segments.build(docs, path)
    edited = docs.where("doc_id % 10 = 3").withColumn("contents", F.lit("replaced by this"))
    segments.change(spark, path, edited, docs.where("doc_id % 10 = 4").select("relative_path"))
    monkeypatch.setattr(segments, "SENT", sent)
    plans, write = [], segments._write
    monkeypatch.setattr(segments, "_write", lambda rows, target, **o: (plans.append((target, _plan(rows))), write(rows, target, **o)))
    segments.compact(spark, path, which={s.number for s in segments.manifest(spark, path).segments})
    assert not [p for t, p in plans if "/docs/" not in t and "Generate explode" in p]
    live = ix.load(spark, path)
    want = sorted(map(tuple, postings(docs.where("doc_id % 10 not in (3, 4)").union(edited)).collect()))
    assert sorted(map(tuple, live.postings.collect())) == want
    rows = live.stored.blocks().count()
    assert rows * 10 < live.stored.postings().count()


def _changing(spark, path):
    scan = _docs(spark, 200, ["some words", "and others", "the last of them"]).withColumns({"modified_unix_secs": F.lit(0).cast("long"), "hash": F.sha2("contents", 256)})
    ix.build(scan, path)
    edited = F.when(F.col("doc_id") % 20 == 3, "replaced by this").otherwise(F.col("contents"))
    return scan.where("doc_id % 20 != 4").withColumn("contents", edited).withColumn("hash", F.sha2("contents", 256))


@pytest.mark.parametrize("sent", [2, 10**6])
def test_frequencies_of_base_and_delta_are_counted_in_blocks(spark, tmp_path, monkeypatch, sent):
    now = _changing(spark, str(tmp_path / "index"))
    assert not ix.apply_changes(spark, str(tmp_path / "index"), now)["rebuild"]
    monkeypatch.setattr(segments, "SENT", sent)
    live = ix.load(spark, str(tmp_path / "index"))
    got = ix.document_frequency(live)
    assert ("Generate explode" in _plan(got)) == (sent == 2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ix.document_frequency(postings(now)).collect()))
    assert dict(got.dtypes) == {"trigram": "int", "docs": "bigint"} and live.stored.n_gone == 20


def test_a_change_shuffles_no_text_that_stays(spark, tmp_path, monkeypatch):
    path, plans, write = str(tmp_path / "index"), [], segments._write
    now = _changing(spark, path)
    monkeypatch.setattr(segments, "_write", lambda rows, target, **o: (plans.append((target, _plan(rows))), write(rows, target, **o)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as if no size were known to be small
    try:
        ix.apply_changes(spark, path, now)
        feed = now.where("doc_id in (5, 6)").select("relative_path", F.lit(False).alias("deleted"))
        segments.apply_feed(spark, path, feed, lambda wanted: now.join(wanted, "relative_path", "left_semi"), generation=1)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    written = [p for t, p in plans if "/docs/" in t]
    assert len(written) == 2 and all("BroadcastHashJoin" in p and "SortMergeJoin [relative_path" not in p.split("LeftSemi")[0] for p in written)
    assert sorted(map(tuple, ix.document_frequency(ix.load(spark, path)).collect())) == sorted(map(tuple, ix.document_frequency(postings(now)).collect()))
