"""Byte trigrams: three bytes b0 b1 b2, A-Z lowered, as b0 << 16 | b1 << 8 | b2."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def encode(three: bytes) -> int:
    return three[0] << 16 | three[1] << 8 | three[2]


def decode(trigram: int) -> bytes:
    return bytes([trigram >> 16 & 255, trigram >> 8 & 255, trigram & 255])


#: Bytes of text whose trigrams are sorted at once, and documents in a block of postings at most.
CHUNK, BLOCK = 1 << 21, 64


def _all(folded: np.ndarray) -> np.ndarray:
    b = folded.astype(np.int32)
    return b[:-2] << 16 | b[1:-1] << 8 | b[2:]


def of_bytes(raw: bytes) -> np.ndarray:
    """Sorted distinct trigrams; fewer than three bytes have none."""
    b = _FOLD[np.frombuffer(raw, dtype=np.uint8)]
    if len(b) < 3:
        return np.zeros(0, dtype=np.int32)
    if len(b) <= CHUNK:
        return np.unique(_all(b))
    seen = np.zeros(1 << 24, dtype=bool)  # the same memory however long a text is
    for at in range(0, len(b) - 2, CHUNK):
        seen[_all(b[at : at + CHUNK + 2])] = True
    return np.flatnonzero(seen).astype(np.int32)


def _pairs(data: np.ndarray, ends: np.ndarray, first: int, last: int) -> np.ndarray:
    """Sorted distinct trigram << 32 | row of the texts first..last - 1; text i is data[ends[i] : ends[i + 1]]."""
    if last == first + 1:
        return of_bytes(data[ends[first] : ends[last]]).astype(np.int64) << 32 | first
    b = _FOLD[data[ends[first] : ends[last]]]
    if len(b) < 3:
        return np.zeros(0, dtype=np.int64)
    row = np.repeat(np.arange(first, last), np.diff(ends[first : last + 1]))
    whole = row[:-2] == row[2:]  # no trigram reaches into the next text
    pairs = (_all(b)[whole].astype(np.int64) << 32) | row[:-2][whole]
    pairs.sort()
    return pairs[np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)]]


def _starts(grams: np.ndarray) -> np.ndarray:
    """Where blocks of sorted trigrams start: at each new one, and after BLOCK of the same."""
    at = np.arange(len(grams))
    same = np.maximum.accumulate(np.where(np.append(True, grams[1:] != grams[:-1])[: len(grams)], at, 0))
    return np.flatnonzero((at - same) % BLOCK == 0)


def _batch(grams: np.ndarray, doc_ids: np.ndarray) -> pa.RecordBatch:
    starts = _starts(grams)
    ends = np.append(starts, len(grams))
    first = doc_ids[starts]
    docs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(doc_ids - np.repeat(first, np.diff(ends)), pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(grams[starts], pa.int32()), pa.array(first, pa.int64()), docs], names=["trigram", "first", "docs"])


def _blocks(batches):
    for batch in batches:
        texts = batch.column(1).fill_null("").cast(pa.large_binary())
        n, (_, ends, data) = len(texts), texts.buffers()
        ends = np.frombuffer(ends, dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, dtype=np.int64)
        data, first, doc_ids = np.frombuffer(data or b"", dtype=np.uint8), 0, batch.column(0).to_numpy()
        while first < n:
            last = max(int(np.searchsorted(ends, ends[first] + CHUNK, "right")) - 1, first + 1)
            pairs = _pairs(data, ends, first, last)
            yield _batch((pairs >> 32).astype(np.int32), doc_ids[pairs & 0xFFFFFFFF])
            first = last


def _left(batch: pa.RecordBatch, gone: dict[int, np.ndarray]) -> pa.RecordBatch:
    """Blocks (trigram, first, docs, segment) without what is gone, packed anew where neighbours have the same trigram."""
    sizes = batch.column(2).value_lengths().to_numpy()
    doc_ids = batch.column(2).flatten().to_numpy() + np.repeat(batch.column(1).to_numpy(), sizes)
    segment, stays = batch.column(3).to_numpy(), np.ones(len(doc_ids), dtype=bool)
    for number, ids in gone.items():
        at = np.flatnonzero(np.repeat(segment == number, sizes))
        near = np.minimum(np.searchsorted(ids, doc_ids[at]), len(ids) - 1)
        stays[at] = ids[near] != doc_ids[at]
    return _batch(np.repeat(batch.column(0).to_numpy(), sizes)[stays], doc_ids[stays])


#: ``docs`` are distances from ``first``, small numbers that pack and shuffle well.
BLOCKS = "trigram int, first long, docs array<long>"


def blocks(docs: DataFrame, column: str = "contents") -> DataFrame:
    """The documents of each trigram, in blocks of BLOCK at most. A task sorts the trigrams of
    CHUNK bytes at a time, so its memory does not grow with its input."""
    keyed = docs.selectExpr("cast(doc_id as long) as doc_id", f"cast(`{column}` as string) as text")
    return keyed.where("doc_id is not null").mapInArrow(_blocks, BLOCKS)  # no row is known without its key


def without(found: DataFrame, gone: dict[int, np.ndarray]) -> DataFrame:
    """Blocks with their segment, less the sorted doc_ids of ``gone`` for each segment, which are sent
    to all tasks; no row is made for a pair."""
    return found.select("trigram", "first", "docs", "segment").mapInArrow(lambda batches: (_left(b, gone) for b in batches), BLOCKS)


def unpacked(found: DataFrame) -> DataFrame:
    """The pairs (trigram, doc_id) of blocks, with their other columns."""
    rest = [c for c in found.columns if c not in ("trigram", "first", "docs")]
    return found.select("trigram", "first", F.explode("docs").alias("far"), *rest).select("trigram", (F.col("first") + F.col("far")).alias("doc_id"), *rest)


def postings(docs: DataFrame, column: str = "contents") -> DataFrame:
    """(trigram int, doc_id long), each pair once for each row of ``docs``."""
    return unpacked(blocks(docs, column))
