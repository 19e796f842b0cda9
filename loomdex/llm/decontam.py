"""Benchmark decontamination by spaced-seed hashing.

Words are runs of letters and digits, lower-cased. A mask fixes which words of a window
count; the others may differ. Every window of every test item is hashed under each mask,
and every window of every training text likewise; equal hashes (confirmed on the words'
own hashes) put item and text on a diagonal. On each diagonal the whole item is laid
beside the text, and the best run of matches (+1 a match, -MISMATCH a substitution) is
the verified overlap. A text is contaminated by an item if that run has at least
``min(MIN_MATCHES, ceil(MIN_SHARE * words of the item))`` matches.

Items under SHORT words are sought by masks that every run with enough matches contains: so
many words in a row, or, from 9 words on, four on either side of a substitution (the score
leaves room for no other one).

The test side is read in blocks of bounded size; each block's hash table is broadcast and
the training side, of any size, streams through without a shuffle. More test items mean
more blocks, never a larger broadcast.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexer import ALNUM, U64, mix64, per_row, words
from .scratch import fresh
from .stream import frugal

#: Fixed masks, weight 6; 1 marks a word that must agree.
MASKS = ("111010011", "1101100011", "11001010011", "110100010101", "1010011000111")
#: Items of fewer words use masks of their own: MASKS miss some verified overlaps of 11 words.
SHORT = 12
AROUND = "111101111"
MIN_MATCHES = 12
MIN_SHARE = 0.7
MISMATCH = 3
#: Pairs of places of one hash that are still listed one by one, and cells verified at a time.
HEAVY = 1 << 16
CELLS = 1 << 20
_FILTER = 1 << 21
_MUL = U64(0x9E3779B97F4A7C15)


def _masked(h: np.ndarray, mask: str, tag: int) -> np.ndarray:
    n = len(h) - len(mask) + 1
    out = np.full(max(n, 0), tag, dtype=U64)
    if n > 0:
        for i, bit in enumerate(mask):
            if bit == "1":
                out = (out ^ h[i : i + n]) * _MUL
                out ^= out >> U64(31)
    return mix64(out)


def _masks_for(length: int) -> list[tuple[int, str]]:
    """(tag, mask) of the masks that an item of so many words uses."""
    if length < SHORT:
        row = needed(length)
        return [(1000 + row, "1" * row)] * (length > 0) + [(2000, AROUND)] * (length >= len(AROUND))
    return [(i + 1, m) for i, m in enumerate(MASKS) if len(m) <= length]


def best_runs(match: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, matches) of the best-scoring run of each row; the first one among equals."""
    n = match.shape[1]
    total = np.zeros((len(match), n + 1), dtype=np.int32)
    np.cumsum(np.where(match, 1, -MISMATCH), axis=1, out=total[:, 1:])
    low = np.minimum.accumulate(total, axis=1)
    end = np.argmax(total - low, axis=1)
    lowest = np.take_along_axis(low, end[:, None], axis=1)
    place = np.arange(n + 1)
    start = np.where((total == lowest) & (place <= end[:, None]), place, -1).max(axis=1)
    hits = np.zeros_like(total)
    np.cumsum(match, axis=1, out=hits[:, 1:])
    at = np.arange(len(match))
    return start, end, hits[at, end] - hits[at, start]


def best_run(match: np.ndarray) -> tuple[int, int, int]:
    """The same for one row."""
    start, end, matches = best_runs(match[None, :])
    return int(start[0]), int(end[0]), int(matches[0])


def needed(length: int) -> int:
    return min(MIN_MATCHES, math.ceil(MIN_SHARE * length))


class TestBlock:
    """Hash table of a block of items: (item id, word hashes)."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items = items
        hashes, item, place, tags = [], [], [], set()
        for k, (_, h) in enumerate(items):
            for tag, mask in _masks_for(len(h)):
                got = _masked(h, mask, tag)
                hashes.append(got)
                item.append(np.full(len(got), k))
                place.append(np.arange(len(got)))
                tags.add((tag, mask))
        self.tags = sorted(tags)
        h = np.concatenate(hashes) if hashes else np.zeros(0, dtype=U64)
        order = np.argsort(h, kind="stable")
        self.hash = h[order]
        self.item = (np.concatenate(item) if item else np.zeros(0, dtype=np.int64))[order]
        self.place = (np.concatenate(place) if place else np.zeros(0, dtype=np.int64))[order]
        self.filter = np.zeros(_FILTER, dtype=bool)
        self.filter[(self.hash & U64(_FILTER - 1)).astype(np.int64)] = True

    def diagonals(self, h: np.ndarray, row: np.ndarray):
        """(row, item, distinct word positions where the item would start, ascending), for
        each row and item that share a window.

        A hash that stands at q places of a row and p places of an item has q * p pairs.
        Where that is much more than the diagonals that there can be (repeated words), the
        pairs are not listed: the differences of both sets of places come from one product
        of Fourier transforms.
        """
        sparse: list[np.ndarray] = []
        dense: dict[tuple[int, int], np.ndarray] = {}
        for tag, mask in self.tags:
            got = _masked(h, mask, tag)
            at = np.flatnonzero(self.filter[(got & U64(_FILTER - 1)).astype(np.int64)])
            at = at[row[at] == row[at + len(mask) - 1]]
            lo, hi = np.searchsorted(self.hash, got[at], "left"), np.searchsorted(self.hash, got[at], "right")
            at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
            if not len(at):
                continue
            order = np.lexsort((at, lo, row[at]))
            at, lo, hi = at[order], lo[order], hi[order]
            cut = np.concatenate([[0], np.flatnonzero((np.diff(lo) != 0) | (np.diff(row[at]) != 0)) + 1, [len(at)]])
            size = np.diff(cut)
            heavy = size * (hi - lo)[cut[:-1]] > HEAVY
            for g in np.flatnonzero(heavy):
                self._spread(dense, at[cut[g] : cut[g + 1]], int(lo[cut[g]]), int(hi[cut[g]]), h, row)
            light = ~np.repeat(heavy, size)
            n = (hi - lo)[light]
            k = np.repeat(lo[light], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            p = np.repeat(at[light], n)
            sparse.append(np.unique(np.stack([row[p], self.item[k], p - self.place[k]], axis=1), axis=0))
        rows = np.unique(np.concatenate(sparse), axis=0) if sparse else np.zeros((0, 3), dtype=np.int64)
        cut = np.flatnonzero((np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0)) + 1
        found = {(int(x[0, 0]), int(x[0, 1])): x[:, 2] for x in np.split(rows, cut) if len(x)}
        for key, (first, hit) in dense.items():
            found[key] = np.union1d(found.get(key, np.zeros(0, dtype=np.int64)), first + np.flatnonzero(hit))
        for (r, k), starts in sorted(found.items()):
            yield r, k, starts

    def _spread(self, dense: dict, at: np.ndarray, lo: int, hi: int, h: np.ndarray, row: np.ndarray) -> None:
        """Adds the diagonals of one hash at the places ``at`` of one row, for all its items."""
        r = int(row[at[0]])
        first, last = np.searchsorted(row, [r, r + 1])
        for k in np.unique(self.item[lo:hi]):
            place = self.place[lo:hi][self.item[lo:hi] == k]
            m = len(self.items[k][1])
            n = int(last - first) + m
            hit = dense.setdefault((r, int(k)), (int(first) - m, np.zeros(n + 1, dtype=bool)))[1]
            q = at - int(first)
            if len(q) * len(place) > 32 * n:
                width = 1 << (n + m).bit_length()
                left, right = np.zeros(width), np.zeros(width)
                left[q] = 1
                right[m - place] = 1
                both = np.fft.irfft(np.fft.rfft(left) * np.fft.rfft(right), width)
                hit |= both[: n + 1] > 0.5
            else:
                few, many, sign = (place, q, -1) if len(place) < len(q) else (q, place, 1)
                for x in few:
                    hit[(many - x if sign < 0 else x - many) + m] = True

    def overlaps(self, h: np.ndarray, row: np.ndarray, lo: int, hi: int, any_: bool = False):
        """Per (row, item) the verified overlap with most matches: (row, item index, matches,
        length, start word in the text, start word in the item), the first one among equals.
        ``any_``: one item of each row is enough, and any verified overlap of it."""
        at = per_row(row, lo, hi)
        out, had = [], -1
        for r, k, starts in self.diagonals(h, row):
            if any_ and r == had:
                continue
            a, b = int(at[r - lo]), int(at[r - lo + 1])
            want = self.items[k][1]
            least = most = needed(len(want))
            if not any_:
                # no diagonal has more matches than words of the item occur in the text at all
                most = int(np.isin(want, h[a:b]).sum()) if len(starts) > 64 else len(want)
            best = (least - 1,)
            span = np.arange(len(want))
            for block in np.array_split(starts, len(starts) * len(want) // CELLS + 1):
                word = block[:, None] + span
                inside = (word >= a) & (word < b)
                first, end, matches = best_runs(inside & (h[np.clip(word, a, b - 1)] == want))
                top = int(matches.argmax())
                if matches[top] > best[0]:
                    i, j = int(first[top]), int(end[top])
                    best = (int(matches[top]), j - i, int(block[top]) + i - a, i)
                if best[0] >= most:
                    break
            if best[0] >= least:
                out.append((r, k, *best))
                had = r
        return out


def test_blocks(benchmark: DataFrame, max_words: int = 500_000):
    """Blocks of items (item_id, text) of about ``max_words`` words, read one after another.
    Items without words are left out; a null item_id is kept as null."""
    held, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    for r in rows.toLocalIterator():
        h = np.concatenate([w.hash for _, _, w in words(pa.array([r["text"]]), ALNUM)])
        if not len(h):
            continue
        held.append((r["item_id"], h))
        size += len(h)
        if size >= max_words:
            yield TestBlock(held)
            held, size = [], 0
    if held:
        yield TestBlock(held)


def _flag(block, names: list[str]):
    def run(batches):
        test = block.value
        for batch in batches:
            hit = np.zeros(batch.num_rows, dtype=bool)
            for lo, hi, w in words(batch.column("text"), ALNUM):
                for r, *_ in test.overlaps(w.hash, w.row, lo, hi, any_=True):
                    hit[r] = True
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(hit)], names=names)

    return run


def _report(block):
    names = ["doc_id", "item_id", "item_words", "matches", "length", "doc_word", "item_word", "start", "end"]

    def run(batches):
        test = block.value
        for batch in batches:
            ids = batch.column("doc_id")
            cells = [[] for _ in names]
            for lo, hi, w in words(batch.column("text"), ALNUM):
                at = per_row(w.row, lo, hi)
                for r, k, m, n, d, i in test.overlaps(w.hash, w.row, lo, hi):
                    first = int(at[r - lo]) + d
                    row = (ids[r].as_py(), test.items[k][0], len(test.items[k][1]), m, n, d, i, int(w.start[first]), int(w.end[first + n - 1]))
                    for cell, x in zip(cells, row):
                        cell.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cells], names=names)

    return run


def overlaps(docs: DataFrame, benchmark: DataFrame, max_words: int = 500_000) -> DataFrame:
    """One row for each (document row, item) with a verified overlap: doc_id, item_id,
    item_words, matches, length (words of the run), doc_word and item_word (where it
    starts), start and end (its bytes in the text).

    Null, empty and wordless texts and items overlap with nothing; repeated rows on either
    side give repeated results; an empty table gives none.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, item_words long, matches long, length long, doc_word long, item_word long, start long, end long"
    out = None
    for block in test_blocks(benchmark, max_words):
        part = base.mapInArrow(frugal(_report(spark.sparkContext.broadcast(block))), schema)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, max_words: int = 500_000) -> DataFrame:
    """``docs``, all columns, without the rows that some item overlaps. No shuffle."""
    spark = docs.sparkSession
    out = docs.withColumn("text", F.col("text").cast("string"))
    flag = fresh(docs, "contaminated")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
    for block in test_blocks(benchmark, max_words):
        out = out.mapInArrow(frugal(_flag(spark.sparkContext.broadcast(block), [*out.columns, flag])), f"{fields}, `{flag}` boolean").where(~F.col(flag)).drop(flag)
    return out
