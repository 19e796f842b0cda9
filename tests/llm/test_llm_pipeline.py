"""Each stage against what it promises on its own input."""

import hashlib
import os

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline as P
from loomdex.llm import mixing
from loomdex.llm.oracle import SQL
from test_llm_operators import brute_components


def plain_mixture(rows, block=4):
    """doc_ids in the order of a schedule walked slot by slot."""
    by = {}
    for d, s in sorted(rows, key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()):
        by.setdefault(s, []).append(d)
    names = sorted(by, key=lambda s: (s is not None, s))
    weight = dict(zip(names, mixing.tempered_weights([len(by[s]) for s in names], 0.5, 1000)))
    blocks = {s: [by[s][i : i + block] for i in range(0, len(by[s]), block)] for s in names}
    out, active = [], list(names)
    while active:
        total, had, t = sum(weight[s] for s in active), dict.fromkeys(active, 0), 0
        while all(blocks[s] for s in active):
            ready = [(-(-(had[s] + 1) * total // weight[s]), names.index(s), s) for s in active if had[s] * total // weight[s] <= t]
            s = min(ready)[2]
            out += blocks[s].pop(0)
            had[s] += 1
            t += 1
        active = [s for s in active if blocks[s]]
    return out


def test_stages(spark, tmp_path, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    frames = []
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        frames.append(docs)
    toxic, unique, clean, mixed, sharded = frames
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns
    assert all(f.columns == columns for f in frames[:-1]) and sharded.columns == [*columns, "shard", "slot"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = toxic.join(labels, "doc_id").where("toxic = 0").count()
    assert kept >= 0.97 * labels.where("toxic = 0").count()
    bad = labels.where("toxic = 1")
    assert toxic.join(bad, "doc_id").count() <= 0.5 * bad.count()  # eleven documents to learn from
    rows = [tuple(r) for r in toxic.select("doc_id", "text", "source").collect()]
    first = {component for _, n, component in brute_components(rows) if n} | {i for i, n, _ in brute_components(rows) if not n}
    assert sorted(first) == sorted(r[0] for r in unique.select("doc_id").collect())
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/near_duplicates/*.parquet'")
    con.sql(f"create view benchmark as select * from '{sf}/benchmark.parquet'")
    found = {r[0] for r in con.sql(f"select distinct doc_id from ({SQL['op5_spaced_seed_decontamination']})").fetchall()}
    assert found and {r[0] for r in unique.select("doc_id").collect()} - found == {r[0] for r in clean.select("doc_id").collect()}
    order = plain_mixture([tuple(r) for r in clean.select("doc_id", "source").collect()])
    assert order == [r[0] for r in mixing.mix(clean).orderBy("mix_position").select("doc_id").collect()]
    files = sorted(f for f in os.listdir(tmp_path / "mixing") if f.endswith(".parquet"))
    assert [r[0] for f in files for r in spark.read.parquet(str(tmp_path / "mixing" / f)).select("doc_id").collect()] == order
    place = {d: i for i, d in enumerate(order)}
    rows = sorted((r["shard"], r["slot"], place[r["doc_id"]]) for r in sharded.collect())
    assert [p for _, _, p in rows] == sorted(p for _, _, p in rows) and len(rows) == mixed.count()
    sizes = sharded.groupBy("shard").agg(F.max("slot").alias("s"), F.count("*").alias("c")).collect()
    assert all(r["s"] == r["c"] - 1 for r in sizes) and 1 < len(sizes) <= 16
    groups, at, group_of = [], {}, {}
    for r in sorted(mixed.select("doc_id", "text").collect(), key=lambda r: place[r["doc_id"]]):  # texts are groups at their first place
        at.setdefault(r["text"], len(groups)) == len(groups) and groups.append(0)
        groups[at[r["text"]]] += len((r["text"] or "").encode()) + 1
        group_of[r["doc_id"]] = at[r["text"]]

    def shards_at(capacity):
        used, out = 0, [0]
        for g in groups:
            out.append(out[-1] + (used + g > capacity))
            used = used + g if out[-1] == out[-2] else g
        return out[1:]

    low, high = max(groups) - 1, sum(groups)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if shards_at(middle)[-1] < 16 else (middle, high)
    want = shards_at(high)
    assert {r["doc_id"]: want[group_of[r["doc_id"]]] for r in sharded.collect()} == {r["doc_id"]: r["shard"] for r in sharded.collect()}


def test_toxic_documents_go(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    left = P.drop_toxic(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).join(labels, "doc_id").groupBy("toxic").count()
    left, all_ = dict(map(tuple, left.collect())), dict(map(tuple, labels.groupBy("toxic").count().collect()))
    assert left.get(1, 0) <= 0.2 * all_[1] and left[0] >= 0.98 * all_[0]


def test_clashing_names(spark, sf, tmp_path):
    """Extra columns named like every helper column go through each stage unharmed."""
    names = ["__rank", "__first", "__until", "__e", "__s", "__w", "__base", "__phase", "__places", "__lack", "__h", "__tie", "__row", "__at", "__file", "__of", "__place", "__key", "__comp", "__id", "__b", "mix_position", "row", "size", "score", "SHARD", "slot"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).withColumns({n: F.lit(f"own {n}") for n in names})
    docs.repartition(2).write.parquet(str(tmp_path / "rows"))
    docs = spark.read.parquet(str(tmp_path / "rows"))
    for name, stage in P.STAGES[1:]:
        for given in (docs, docs.sort("doc_id").limit(60)):  # from files, and not
            out = stage(spark, given, sf)
            assert out.columns == (docs.columns if name != "sharding" else [*docs.columns[:-2], "shard", "slot"])
            assert out.select(*names[:-2]).distinct().collect() == [tuple(f"own {n}" for n in names[:-2])] and out.count() > 40


def test_repeated_and_null_ids(spark, sf):
    rows = [(1, "a b c d e f g", "en", "s", 1), (1, "a b c d e f g", "en", "s", 1), (None, "a b c d e f g", "en", "s", 1), (None, "q r s t u v", "en", "s", 1), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (4, "A b c d e f g", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = P.drop_near_duplicates(spark, docs, sf).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == [(0, "q r s t u v"), (1, "a b c d e f g"), (2, ""), (3, "")]


def test_one_row_of_each_group_stays(spark, sf, tmp_path):
    one, near = "a b c d e f g h i j k l m n o p q r s t u v w x", "a b c d e f g h i j k l m n o p q r s t u v w y"
    rows = [(None, near), (None, one), (None, "null id of its own text"), (None, None), (None, " "), (7, "again one two three four"), (7, one), (1, one), (1, near), (9, ""), (None, "of null ids only"), (None, "of null ids only")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "rows"))
    for given in (docs, spark.read.parquet(str(tmp_path / "rows"))):
        got = [(r["doc_id"] or 0, r["text"] or "") for r in P.drop_near_duplicates(spark, given, sf).collect()]
        kept = [x for x in got if x[1] in (one, near)]
        assert len(kept) == 1 and kept[0][0] == 1  # either text of id 1: the first in its files
        assert sorted(x for x in got if x not in kept) == [(0, ""), (0, " "), (0, "null id of its own text"), (0, "of null ids only"), (7, "again one two three four"), (9, "")]


def test_null_copy_drops_no_other_null_id(spark, sf):
    rows = [(1, "a b c d e f g", "en"), (None, "a b c d e f g", "en"), (None, "q r s t u v", "en"), (None, None, "en")]
    got = P.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), sf).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == [(0, ""), (0, "q r s t u v"), (1, "a b c d e f g")]
