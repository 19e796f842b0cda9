"""Versions of an index on disk: crashes, writers at once, changes, merging, path postings, batches."""

import os
import random

import pytest
from pyspark.sql import functions as F

from loomdex.functions import text
from loomdex.operators import index as ix, search as se, segments
from loomdex.operators.lookup import LOOKUP, ranges, spans
from loomdex.plans.request import InvalidQuery, SearchRequest
from test_operators import docs, live

RND = random.Random(3)


@pytest.fixture(autouse=True)
def every_index_pays(monkeypatch):
    """These indexes are small; they are to be used as large ones are."""
    monkeypatch.setattr(se, "JOB_BYTES", 0)


def corpus(spark, n=300, edit=lambda i: ""):
    rows = [(i, f"d{i % 7}/Part{i % 11}/f{i:04}.txt", f"common text number{i:05} " + "filler words " * 30 + ("needle" if i % 50 == 3 else "") + edit(i)) for i in range(n)]
    return docs(spark, rows).withColumns({"modified_unix_secs": F.lit(0).cast("long"), "hash": text.sha256(F.col("contents"))})


def found(index, pattern, engine=None, **more):
    return sorted(tuple(r) for r in se.search(index, SearchRequest(pattern=pattern, **more), engine).collect())


def paths(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "relative_path string")


def test_a_lost_writer_changes_nothing(spark, tmp_path, monkeypatch):
    """Whatever write a build or a change gets to, the version before it stays and is whole."""
    path, given = str(tmp_path / "index"), corpus(spark).cache()
    segments.build(given, path)
    before = ix.metadata(spark, path)
    write, lost = segments._write, 0
    steps = {
        "build": lambda: segments.build(given.where("doc_id < 9"), path),
        "change": lambda: segments.change(spark, path, given.where("doc_id = 3").withColumn("contents", F.lit("gone")), paths(spark, "d0/Part0/f0000.txt")),
        "compact": lambda: segments.compact(spark, path, which={s.number for s in segments.manifest(spark, path).segments}),
    }
    for run in steps.values():
        committing, at = [False], 0
        while not committing[0]:
            calls = [0]

            def step(*args, _at=at, _calls=calls, **kw):
                _calls[0] += 1
                if _calls[0] > _at:
                    raise OSError("lost")
                write(*args, **kw)

            def last(*args, _committing=committing):
                _committing[0] = True
                raise OSError("lost")

            with monkeypatch.context() as m:
                m.setattr(segments, "_write", step)
                m.setattr(segments, "commit", last)
                with pytest.raises(OSError):
                    run()
            assert ix.metadata(spark, path) == before
            lost, at = lost + 1, at + 1
    assert lost == 5 + 6 + 4  # before each write and before the commit
    now = ix.load(spark, path)
    assert len(found(now, "needle", "indexed")) == 6 == len(found(now, "needle", "direct_scan"))
    segments.vacuum(spark, path, keep=1)
    assert len(os.listdir(f"{path}/docs")) == 1 and len(found(ix.load(spark, path), "needle")) == 6


def test_of_two_writers_one_is_told(spark, tmp_path):
    path, given = str(tmp_path / "index"), corpus(spark, 20)
    m = segments.build(given, path)
    with pytest.raises(segments.Conflict):
        segments.commit(spark, path, m)
    assert segments.versions(spark, path) == [m.version]
    with pytest.raises(FileNotFoundError):
        ix.load(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        ix.load(spark, path, version=9)


def test_changes_are_searched_at_index_speed(spark, tmp_path):
    """Frequencies, lookups and postings of changes; a reader keeps its version."""
    path, given = str(tmp_path / "index"), corpus(spark).cache()
    segments.build(given, path)
    old = ix.load(spark, path)
    edited = given.where("doc_id in (3, 7)").withColumn("contents", F.when(F.col("doc_id") == 7, "edited needle").otherwise("nothing"))
    added = docs(spark, [(900, "new/added.txt", "added needle")]).withColumns({"modified_unix_secs": F.lit(0).cast("long"), "hash": F.lit("h")})
    segments.change(spark, path, edited.unionByName(added), paths(spark, "d4/Part9/f0053.txt", "not/there.txt"))
    now = ix.load(spark, path)
    want = sorted([r[0] for r in given.where("doc_id = 7").select("relative_path").collect()] + [r[0] for r in given.where("doc_id % 50 = 3 and doc_id not in (3, 53)").select("relative_path").collect()] + ["new/added.txt"])
    for engine in ("indexed", "direct_scan"):
        assert [r[0] for r in found(now, "needle", engine)] == want and len(found(old, "needle", engine)) == 6
    m = segments.manifest(spark, path)
    live_docs = now.docs.collect()
    assert m.docs == len(live_docs) == 300 and m.bytes == sum(r["size"] for r in live_docs) and len(m.segments) == 2 and now.stored.n_gone == 3
    counted = {r["trigram"]: r["docs"] for r in ix.document_frequency(now.postings).collect()}
    assert counted == {r["trigram"]: r["docs"] for r in now.stored.frequency().where(F.col("trigram") < segments.PATH).collect()}
    assert (m.postings, m.trigrams) == (sum(counted.values()), len(counted)) and now.frequency().of(ix.trigrams_of("nee")[0]) == 6
    plan = se.candidate_docs(now, SearchRequest(pattern="number00123"), "indexed")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id" in plan or "EqualTo(doc_id" in plan or "In(doc_id" in plan  # a lookup, no join


def test_segments_merge_in_tiers(spark, tmp_path):
    path, given = str(tmp_path / "index"), corpus(spark, 40).cache()
    segments.build(given, path)
    for i in range(segments.FANOUT + 1):
        segments.change(spark, path, given.where(F.col("doc_id") == i).withColumn("contents", F.lit(f"change{i:02} needle")), paths(spark))
    m = segments.manifest(spark, path)
    assert len(m.segments) < segments.FANOUT and m.docs == 40 and sum(s.docs - s.gone for s in m.segments) == 40
    now = ix.load(spark, path)
    assert len(found(now, "change", "indexed")) == segments.FANOUT + 1 and found(now, "needle", "indexed") == found(now, "needle", "direct_scan")
    all_ = segments.compact(spark, path, which={s.number for s in m.segments})
    assert [(s.docs, s.gone) for s in all_.segments] == [(40, 0)] and all_.gone == () and segments.compact(spark, path) is None
    assert found(ix.load(spark, path), "needle", "indexed") == found(now, "needle", "direct_scan")
    # a segment that is half gone is written anew, one that is all gone is dropped
    m = segments.change(spark, path, given.where("doc_id < 0"), given.where("doc_id < 21").select("relative_path"))
    assert [(s.docs, s.gone) for s in m.segments] == [(19, 0)]
    m = segments.change(spark, path, given.where("doc_id < 0"), given.select("relative_path"))
    assert m.segments == () and m.docs == m.bytes == m.postings == 0 and found(ix.load(spark, path), "needle") == []


def test_a_feed_reads_the_named_files_and_is_applied_once(spark, tmp_path):
    path, given, asked = str(tmp_path / "index"), corpus(spark, 60).cache(), []
    segments.build(given, path, applied=4)

    def read(wanted):
        asked.append(sorted(r[0] for r in wanted.collect()))
        return given.where("doc_id = 5").withColumn("contents", F.lit("fed needle")).join(wanted, "relative_path", "left_semi")

    name = {i: r for r, i in given.select("relative_path", "doc_id").collect()}
    feed = spark.createDataFrame([(name[5], False), (name[6], True), (name[7], False), (name[5], False)], "relative_path string, deleted boolean")
    assert segments.apply_feed(spark, path, feed, read, generation=4).docs == 60 and asked == []
    m = segments.apply_feed(spark, path, feed, read, generation=5)
    assert asked == [sorted([name[5], name[7]])] and m.docs == 58 and m.applied == 5  # 6 was deleted, 7 is not there any more
    assert segments.apply_feed(spark, path, feed, read, generation=5) == m and len(asked) == 1
    assert sorted(r[0] for r in found(ix.load(spark, path), "needle")) == sorted([name[3], name[53], name[5]])


def test_path_postings_lose_nothing(spark, tmp_path):
    path, given = str(tmp_path / "index"), corpus(spark, 120).cache()
    segments.build(given, path)
    segments.change(spark, path, given.where("doc_id < 5").withColumn("contents", F.lit("x")), paths(spark, "d3/Part3/f0003.txt"))
    segments.change(spark, path, given.where("doc_id between 20 and 24").withColumn("extension", F.lit("en")), paths(spark))  # not what its path ends with
    index = ix.load(spark, path)
    names = [r[0] for r in index.docs.select("relative_path").collect()]
    asked = [SearchRequest(pattern=n[a : a + RND.randint(1, 9)].swapcase(), kind="path") for n in RND.sample(names, 6) for a in [RND.randint(0, len(n) - 2)]]
    asked += [SearchRequest(kind="path", exact_names=("F0007.TXT", "f0008.txt")), SearchRequest(kind="path", extensions=("TXT",)), SearchRequest(kind="path", extensions=(".EN",), path_prefixes=("d",)), SearchRequest(kind="path", path_prefixes=("d1/Part",), path_substrings=("PART1/", "9/")), SearchRequest(kind="path", globs=("d2*",)), SearchRequest(pattern="zzz", kind="path")]
    asked += [SearchRequest(pattern="number", path_substrings=("part1/",)), SearchRequest(pattern="needle", exact_paths=tuple(names[:9]))]
    for r in asked:
        assert sorted(map(tuple, se.search(index, r).collect())) == sorted(map(tuple, se.search(index, r, "direct_scan").collect())), r
    few = se.candidate_paths(index, SearchRequest(pattern="f0077", kind="path"))
    assert [r[0] for r in few.select("relative_path").collect()] == ["d0/Part0/f0077.txt"]


def test_path_and_text_literals_are_different(spark, tmp_path):
    path = str(tmp_path / "index")
    segments.build(docs(spark, [(1, "needle.txt", "straw"), (2, "straw.txt", "needle"), (3, "needle/needle.txt", "needle")]), path)
    index = ix.load(spark, path)
    assert [r[0] for r in found(index, "needle", path_substrings=("needle",), engine=None)] == ["needle/needle.txt"]
    assert [r[0] for r in found(index, "needle")] == ["needle/needle.txt", "straw.txt"]


def test_batch_equals_single_searches(spark, tmp_path):
    path = str(tmp_path / "index")
    given = corpus(spark, 90).unionByName(docs(spark, [(500, "a.md", "Foo foo\n\nneedle foo\n"), (501, "b.md", None)]), allowMissingColumns=True)
    segments.build(given, path)
    segments.change(spark, path, given.where("doc_id = 3"), paths(spark, "d4/Part9/f0053.txt"))
    batch = {
        "one": SearchRequest(pattern="needle"), "same": SearchRequest(pattern="needle"), "ci": SearchRequest(pattern="FOO", case="insensitive"), "scan": SearchRequest(pattern="o", max_results=3), "none": SearchRequest(pattern="zzzzz"),
        "regex": SearchRequest(pattern=r"number000(1|2)\d|foo$", kind="regex"), "per": SearchRequest(pattern="foo", max_results=1, limit_mode="per_file"), "path": SearchRequest(pattern="text", path_prefixes=("d1/",), globs=("*f00*",)), "first": SearchRequest(pattern="common", max_results=4),
    }
    for index in (ix.load(spark, path), live(spark)):
        for part in (batch, {k: v for k, v in batch.items() if k != "scan"}):
            got = sorted(tuple(r) for r in se.search_many(index, part).collect())
            assert got == sorted((name, *r) for name, q in part.items() for r in map(tuple, se.search(index, q, "direct_scan").collect()))
    assert se.search_many(index, {}).collect() == []
    with pytest.raises(InvalidQuery):
        se.search_many(index, {"p": SearchRequest(pattern="a", kind="path")})


@pytest.mark.parametrize("pattern", ["abc(", "[a", "abc(?#x)def", "a{2,1}", "(?<n>a)(?<n>b)", "*a"])
def test_patterns_that_are_none_are_refused(spark, pattern):
    with pytest.raises(InvalidQuery):
        se.search(live(spark), SearchRequest(pattern=pattern, kind="regex"))


def test_ranges_hold_the_keys(spark):
    keys = [(s, i) for s in (1, 2**47) for i in RND.sample(range(10_000), 200)]
    every = spark.range(10_000).select(F.col("id").alias("doc_id"), F.explode(F.array(F.lit(1).cast("long"), F.lit(2**47), F.lit(5).cast("long"))).alias("segment"))
    assert sorted((r["segment"], r["doc_id"]) for r in every.where(ranges(keys)).collect()) == sorted(keys)
    assert every.where(ranges([])).count() == 0 and spans([3], 4) == [(3, 3)] and LOOKUP > 1000


def test_a_limit_reads_no_more_than_it_needs(spark, tmp_path, monkeypatch):
    path, given = str(tmp_path / "index"), corpus(spark).cache()
    segments.build(given, path)
    segments.change(spark, path, given.where("doc_id = 7").withColumn("contents", F.lit("common text")), paths(spark, "d0/Part0/f0000.txt"))
    index, read = ix.load(spark, path), []
    lookup = se.ranges
    monkeypatch.setattr(se, "ranges", lambda keys: read.append(len(keys)) or lookup(keys))
    for r in (SearchRequest(pattern="common", max_results=5), SearchRequest(pattern="needle", max_results=4), SearchRequest(pattern="needle", max_results=99), SearchRequest(pattern="o", max_results=40), SearchRequest(pattern="zzzz", max_results=1), SearchRequest(pattern="common", max_results=3, path_prefixes=("d3/",)), SearchRequest(pattern="common|nothing", kind="regex", max_results=200)):
        read.clear()
        got, want = [tuple(x) for x in se.search(index, r).collect()], [tuple(x) for x in se.search(index, r, "direct_scan").collect()]
        assert sorted(got) == sorted(want), r
        if r.max_results <= 5 and r.pattern == "common":
            assert sum(read) <= 2 * se.FIRST  # of 299 documents, all of which match
    monkeypatch.setattr(se, "LOOKUP", 100)  # too few to fill the limit: all candidates are verified
    assert se.search(index, SearchRequest(pattern="common", max_results=200)).count() == 200


def test_a_small_index_is_scanned(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    segments.build(corpus(spark, 60), path)
    index = ix.load(spark, path)
    by_index = found(index, "needle"), found(index, "PART1", kind="path")
    monkeypatch.setattr(se, "JOB_BYTES", 64 << 20)
    monkeypatch.setattr(se, "_narrowed", None)  # not called
    assert (found(index, "needle"), found(index, "PART1", kind="path")) == by_index and found(index, "zzqq") == []
