"""Byte-level BPE by ranks: texts to ids and back, over numpy matrices.

A text is cut into pieces by a pattern. A piece that is a token is that token; any other
starts as single bytes, and its leftmost pair of minimum rank is merged until no pair has one.
Distinct pieces of a batch are laid out in matrices, one for each bucket of lengths, padded at
their end. In each round every row that can still merge does so once, which takes one column
off the matrix; rows that are done leave it. The rank of a pair is looked up in a hash table of
all ways to cut a token into two. Pieces longer than the widest matrix are merged one by one in
the same order, by a heap over a linked list, so their time grows as n log n.

No shuffle: texts stream through tasks. The tables (a few MB, bounded by the vocabulary) are
broadcast. Pieces seen before are looked up in a table that starts anew when it is full.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import fresh
from .stream import frugal

NONE = np.int32(2**31 - 1)
#: Widest row of each matrix; longer pieces go to the heap.
BUCKETS = (4, 8, 12, 16, 24, 32, 48, 64, 128, 256)
#: Rows of a matrix at a time, pieces and bytes of pieces kept, and bytes of text taken at a time.
ROWS, KEPT, KEPT_BYTES, TAKEN = 1 << 15, 1 << 18, 1 << 23, 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left id, right id) to the id of their concatenation: open addressing over arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, int(2 * len(keys)).bit_length())
        self.mask, self.shift = np.uint64(size - 1), np.uint64(64 - size.bit_length() + 1)
        self.keys, self.values = np.full(size, -1, dtype=np.int64), np.full(size, NONE, dtype=np.int32)
        self.probes = 0
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot[left]] < 0
            takers, first = np.unique(slot[left[free]], return_index=True)
            who = left[free][first]
            self.keys[takers], self.values[takers] = keys[who], values[who]
            left = np.setdiff1d(left, who, assume_unique=True)
            slot[left] = slot[left] + 1 & int(self.mask)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * _MIX >> self.shift).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE without one; an id below 0 is padding and has none."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF
        out = np.full(keys.shape, NONE, dtype=np.int32)
        keys, flat = keys.ravel(), out.ravel()
        at = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slot = self._slot(keys[at])
        for _ in range(self.probes):
            found = self.keys[slot]
            hit = found == keys[at]
            flat[at[hit]] = self.values[slot[hit]]
            on = ~hit & (found >= 0)
            if not on.any():
                break
            at, slot = at[on], slot[on] + 1 & int(self.mask)
        return out


@dataclass
class Vocabulary:
    pattern: str
    ranks: dict[bytes, int]
    pairs: PairTable
    single: np.ndarray  # id of each byte
    flat: np.ndarray  # bytes of all tokens in order of id
    start: np.ndarray


def read_vocabulary(path: str, pattern: str) -> Vocabulary:
    """A rank file (a token in base64 and its rank a line), read by the driver. Each byte has
    to be a token. ``pattern`` cuts texts into pieces; what it does not match is left out."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"{len(missing)} bytes are no tokens in {path}")
    cuts = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    cut = np.array(cuts, dtype=np.int64).reshape(-1, 3)
    tokens = [b""] * (max(ranks.values()) + 1)
    for t, r in ranks.items():
        tokens[r] = t
    start = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
    return Vocabulary(pattern, ranks, PairTable(cut[:, 0] << 32 | cut[:, 1], cut[:, 2].astype(np.int32)), np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32), np.frombuffer(b"".join(tokens), dtype=np.uint8), start)


def merge_rows(ids: np.ndarray, pairs: PairTable) -> list[np.ndarray]:
    """Ids of each row of a padded matrix of byte ids (padding -1, at the end) after all merges."""
    out: list[np.ndarray] = [None] * len(ids)
    row = np.arange(len(ids))
    ranks = pairs.of(ids[:, :-1], ids[:, 1:])
    while len(row):
        at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(row), dtype=np.int64)
        best = ranks[np.arange(len(row)), at] if ranks.shape[1] else np.full(len(row), NONE)
        on = best < NONE
        for r, x in zip(row[~on], ids[~on]):
            out[r] = x[x >= 0]
        row, ids, ranks, at, best = row[on], ids[on], ranks[on], at[on], best[on]
        if not len(row):
            break
        n, every = np.arange(len(row)), np.arange(ids.shape[1] - 1)
        ids = np.take_along_axis(ids, every + (every > at[:, None]), axis=1)
        ids[n, at] = best
        # the pair at the merge goes; those beside it have new ranks
        kept = every[:-1]
        ranks = np.take_along_axis(ranks, kept + (kept >= at[:, None]), axis=1)
        has = at > 0
        ranks[n[has], at[has] - 1] = pairs.of(ids[n[has], at[has] - 1], ids[n[has], at[has]])
        has = at < ids.shape[1] - 1
        ranks[n[has], at[has]] = pairs.of(ids[n[has], at[has]], ids[n[has], at[has] + 1])
    return out


def merge_long(piece: bytes, vocabulary: Vocabulary) -> np.ndarray:
    """Ids of one piece of any length: the same merges, found by a heap of (rank, place)."""
    ids = vocabulary.single[np.frombuffer(piece, dtype=np.uint8)]
    ranks = vocabulary.pairs.of(ids[:-1], ids[1:])
    heap = [(int(r), int(i)) for i, r in enumerate(ranks) if r < NONE]
    heapq.heapify(heap)
    after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    start, token, rank = list(range(len(ids) + 1)), ids.tolist(), ranks.tolist()
    end = len(ids)

    def renew(i: int) -> None:
        j = after[i]
        r = vocabulary.ranks.get(piece[start[i] : start[after[j]]], -1) if j < end else -1
        rank[i] = r
        if r >= 0:
            heapq.heappush(heap, (r, i))

    while heap:
        r, i = heapq.heappop(heap)
        if token[i] < 0 or rank[i] != r or after[i] >= end:
            continue  # merged or renewed meanwhile
        j = after[i]
        token[i], token[j] = r, -1
        after[i] = after[j]
        if after[j] < end:
            before[after[j]] = i
        renew(i)
        if before[i] >= 0:
            renew(before[i])
    return np.array([t for t in token if t >= 0], dtype=np.int32)


def encode_pieces(pieces: list[bytes], vocabulary: Vocabulary) -> list[np.ndarray]:
    """Ids of each piece."""
    out: list[np.ndarray] = [None] * len(pieces)
    open_: list[int] = []
    for i, p in enumerate(pieces):
        r = vocabulary.ranks.get(p)
        if r is not None:
            out[i] = np.array([r], dtype=np.int32)
        elif len(p) > BUCKETS[-1]:
            out[i] = merge_long(p, vocabulary)
        else:
            open_.append(i)
    size = np.array([len(pieces[i]) for i in open_], dtype=np.int64)
    bucket = np.searchsorted(BUCKETS, size)
    for b in np.unique(bucket):
        of = np.flatnonzero(bucket == b)
        for lo in range(0, len(of), ROWS):
            some = of[lo : lo + ROWS]
            width = int(size[some].max())
            raw = np.frombuffer(b"".join(pieces[open_[k]].ljust(width, b"\0") for k in some), dtype=np.uint8).reshape(-1, width)
            ids = np.where(np.arange(width) < size[some][:, None], vocabulary.single[raw], np.int32(-1))
            for k, x in zip(some, merge_rows(ids, vocabulary.pairs)):
                out[open_[k]] = x
    return out


class _Numbers(dict):
    """Numbers pieces in the order in which they are first asked for."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


class Encoder:
    """Ids of texts; keeps those of pieces it has met, up to KEPT and KEPT_BYTES."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.find = vocabulary, regex.compile(vocabulary.pattern).findall
        self._clear()

    def _clear(self) -> None:
        self.known = _Numbers()
        self.flat, self.start, self.bytes = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64), 0

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, where each text's begin and the last one's end)."""
        if len(self.known) > KEPT or self.bytes > KEPT_BYTES:
            self._clear()
        cut = [self.find(t) for t in texts]
        known, first = self.known, len(self.known)
        use = np.array([n for found in cut for n in map(known.__getitem__, found)], dtype=np.int64)
        new = [p.encode("utf-8", "replace") for p in list(known)[first:]] if len(known) > first else []
        if new:
            ids = encode_pieces(new, self.vocabulary)
            self.flat = np.concatenate([self.flat, *ids])
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum([len(x) for x in ids])])
            self.bytes += sum(map(len, new))
        out, end = _gather(self.flat, self.start, use)
        return out, np.concatenate([[0], end[np.cumsum([len(found) for found in cut])]]) if texts else np.zeros(1, dtype=np.int64)


def _gather(flat: np.ndarray, start: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries ``use`` of a list of lists, one after the other, and where each begins."""
    size = start[use + 1] - start[use]
    begin = np.concatenate([[0], np.cumsum(size)])
    return flat[np.repeat(start[use] - begin[:-1], size) + np.arange(begin[-1])], begin


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows of about TAKEN bytes together, at least one."""
    lo, total = 0, np.concatenate([[0], np.cumsum(sizes)])
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + TAKEN, "right")) - 1)
        yield lo, hi
        lo = hi


def _kept(batch: pa.RecordBatch, lo: int, hi: int, drop: str) -> list[pa.Array]:
    return [batch.column(c).slice(lo, hi - lo) for c in batch.schema.names if c != drop]


def _encode(shared, work: str, names: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            column = batch.column(work)
            for lo, hi in _slices(np.diff(np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1])):
                ids, begin = encoder.encode([(t or b"").decode("utf-8", "replace") for t in column.slice(lo, hi - lo).to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*_kept(batch, lo, hi, work), lists], names=names)

    return run


def _decode(shared, work: str, names: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            column = batch.column(work)
            for lo, hi in _slices(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) * 4):
                part = column.slice(lo, hi - lo)
                ids = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                if len(ids) and (ids.min() < 0 or ids.max() + 1 >= len(v.start)):
                    raise ValueError("an id is not in the vocabulary")
                raw, begin = _gather(v.flat, v.start, ids)
                at = np.concatenate([[0], np.cumsum(part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
                out = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(begin[at].astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
                yield pa.RecordBatch.from_arrays([*_kept(batch, lo, hi, work), out], names=names)

    return run


def _mapped(df: DataFrame, vocabulary: Vocabulary, work, kept: list[str], made: tuple[str, str], how) -> DataFrame:
    """Columns ``kept`` and what ``how`` makes of the column ``work``."""
    spark = df.sparkSession
    source = fresh(df, "__work")
    base = df.select(*[F.col(f"`{c}`") for c in kept], work.alias(source))
    names = [*kept, made[0]]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in base.schema.fields[:-1])
    return base.mapInArrow(frugal(how(spark.sparkContext.broadcast(vocabulary), source, names)), f"{schema}`{made[0]}` {made[1]}")


def encode(docs: DataFrame, vocabulary: Vocabulary, column: str = "text", keep: list[str] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of ``docs`` plus ids array<int>: the tokens of each whole text.

    A null text has none, as the empty one. Bytes that are not UTF-8 count as U+FFFD, and
    strings of special tokens are ordinary text. Repeated rows get equal ids. If ``keep``
    has a column named ids, the new one gets an underscore at its end.
    """
    text = F.coalesce(F.col(column).cast("string").cast("binary"), F.lit(b""))
    return _mapped(docs, vocabulary, text, list(keep), (fresh(docs.select(*keep), "ids"), "array<int>"), _encode)


def decode(tokens: DataFrame, vocabulary: Vocabulary, column: str = "ids") -> DataFrame:
    """``tokens`` plus decoded binary: the bytes of the ids in ``column``. Null counts as no
    ids; an id that the vocabulary lacks, or a null one, is an error."""
    ids = F.coalesce(F.col(column), F.expr("cast(array() as array<int>)"))
    return _mapped(tokens, vocabulary, ids, tokens.columns, (fresh(tokens, "decoded"), "binary"), _decode)
