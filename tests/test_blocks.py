"""Postings in blocks: the same pairs, rows for blocks only, and memory that does not follow the input."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomdex.functions import trigrams
from loomdex.operators import index as ix, segments

COLUMNS = "doc_id long, relative_path string, file_name string, extension string, size long, contents string"


def _docs(spark, n, texts):
    rows = [(i, f"src/f{i}.txt", f"f{i}.txt", "txt", len(texts[i % len(texts)]), texts[i % len(texts)]) for i in range(n)]
    return spark.createDataFrame(rows, COLUMNS)


def _texts(n=400, seed=1):
    random.seed(seed)
    return [None if random.random() < 0.1 else "".join(random.choice("abcABé \n") for _ in range(random.choice([0, 1, 2, 3, 5, 50, 400]))) for _ in range(n)]


def test_pairs_of_any_chunk_are_those_of_each_text(monkeypatch):
    texts = _texts()
    ids = [random.randrange(10**12) for _ in texts]
    low = lambda b: bytes(c + 32 if 65 <= c <= 90 else c for c in b)
    want = sorted({(trigrams.encode(b[i : i + 3]), d) for t, d in zip(texts, ids) if t for b in [low(t.encode())] for i in range(len(b) - 2)})
    whole = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    for chunk in (1 << 21, 1000, 7):  # 7: longer texts are taken in parts
        monkeypatch.setattr(trigrams, "CHUNK", chunk)
        for batches in ([whole], [whole.slice(0, 150), whole.slice(150)]):
            got = [(g, first + d) for out in trigrams._blocks(batches) for g, first, docs in zip(*[c.to_pylist() for c in out.columns]) for d in docs]
            assert sorted(got) == want


def test_a_task_holds_the_pairs_of_few_texts_at_a_time():
    """What one batch of documents gives comes in parts of about CHUNK bytes of text."""
    text = bytes(np.random.default_rng(1).integers(97, 123, 4000, dtype=np.uint8)).decode()
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000), pa.int64()), pa.array([text] * 5000)], names=["doc_id", "text"])
    sizes = [out.nbytes for out in trigrams._blocks([batch])]
    assert len(sizes) >= 5000 * 4000 // trigrams.CHUNK and max(sizes) < 16 * trigrams.CHUNK


def test_postings_on_disk_are_blocks(spark, tmp_path):
    path = str(tmp_path / "index")
    ix.build(_docs(spark, 3000, ["the same words everywhere", "and others too"]), path)
    live = ix.load(spark, path)
    rows = spark.read.parquet(*[f"{path}/postings/segment={s.number}" for s in live.stored.manifest.segments]).count()
    pairs = live.stored.postings().count()
    assert rows * 10 < pairs and live.stored.postings().distinct().count() == pairs


def test_merged_blocks_lose_what_is_gone_and_nothing_else(spark, tmp_path):
    path, docs = str(tmp_path / "index"), _docs(spark, 500, [t or "" for t in _texts(500, 2)])
    segments.build(docs, path)
    edited = docs.where("doc_id % 10 = 3").withColumn("contents", F.lit("replaced by this"))
    segments.change(spark, path, edited, docs.where("doc_id % 10 = 4").select("relative_path"))
    segments.change(spark, path, docs.where("doc_id = 4"), docs.select("relative_path").limit(0))  # a segment without losses
    segments.compact(spark, path, which={s.number for s in segments.manifest(spark, path).segments})
    now = docs.where("doc_id % 10 not in (3, 4) or doc_id = 4").union(edited)
    want = sorted(map(tuple, trigrams.postings(now).collect()))
    assert sorted(map(tuple, ix.load(spark, path).postings.collect())) == want and len(set(want)) == len(want)


def test_memory_of_extracting_and_of_filtering_does_not_follow_the_input():
    """The most that numpy holds at once is the same for one batch of few texts and of many."""
    text = bytes(np.random.default_rng(2).integers(97, 123, 4000, dtype=np.uint8)).decode()
    gone = {1: np.arange(0, 10_000, 7)}

    def most(n):
        batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([text] * n)], names=["doc_id", "text"])
        tracemalloc.start()
        try:
            for out in trigrams._blocks([batch]):
                trigrams._left(out.append_column("segment", pa.array([1] * out.num_rows, pa.int64())), gone)
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    assert most(6000) < 1.2 * most(1200)
