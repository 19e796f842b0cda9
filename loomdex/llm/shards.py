"""Sharding by minimax contiguous partition.

Documents of equal text are one atomic group; groups stand in the order of their first
document. The smallest capacity with which a greedy walk needs at most ``n_shards`` shards
is found by binary search, and the cuts are the greedy ones at that capacity.

The running sums of group sizes stay distributed. The driver holds a ladder of group
boundaries: first about RUNGS of them, evenly over the bytes. A greedy step then lands
between two rungs, which bounds it from below and above; capacities for which both bounds
agree are decided, and only stretches that the undecided ones can reach are read again, at
64 times the resolution, until the answer is exact. What is read is bounded by RUNGS and
n_shards, not by the number of groups.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import dealt, running
from .scratch import Scratch

RUNGS = 4096
ROWS_A_BUCKET = 20_000
#: Groups of one row in so many at least are joined by broadcast: there are no more of them than this.
HOT_SHARE = 10_000


class Ladder:
    """Known group boundaries; ``solid[b]``: no group boundary between b and the next."""

    def __init__(self, total: int):
        self.total = total
        self.bounds: list[int] = [0, total]
        self.solid: dict[int, bool] = {0: False}

    def add(self, pieces: list[tuple[int, int]]) -> None:
        """Pieces (first boundary, number of groups) that make up a stretch."""
        for start, groups in pieces:
            self.solid[start] = groups == 1
        self.bounds = sorted({*self.bounds, *(s for s, _ in pieces)})

    def step(self, at: int, capacity: int) -> int:
        """The last known boundary within reach."""
        return self.bounds[bisect_right(self.bounds, at + capacity) - 1]

    def reach(self, at: int, capacity: int) -> int:
        """A bound from above on the last boundary within reach."""
        known = self.step(at, capacity)
        return known if known == self.total or self.solid.get(known, False) else min(at + capacity, self.total)

    def walk(self, capacity: int, n_shards: int, step) -> list[int]:
        out = [0]
        while len(out) <= n_shards and out[-1] < self.total:
            out.append(step(out[-1], capacity))
        return out


def _least(lo: int, hi: int, true) -> int:
    """Least value in (lo, hi] for which a monotone test holds; it holds for hi."""
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if true(mid) else (mid, hi)
    return hi


def capacity_and_cuts(groups: DataFrame, n_shards: int) -> tuple[int, list[int]]:
    """``groups``: materialised (start long, bytes long). (capacity, starts of the shards)."""
    total, largest = groups.agg(F.sum("bytes"), F.max("bytes")).first()
    if not total:
        return 0, [0]
    ladder = Ladder(int(total))
    low = max(int(largest), -(-int(total) // n_shards)) - 1
    high = low + 1 + int(largest)
    stretches, resolution = [(0, int(total))], RUNGS
    while True:
        inside = None
        for a, b in stretches:
            part = F.col("start").between(a, b)
            inside = part if inside is None else inside | part
        rung = F.floor(F.col("start").cast("double") / F.lit(float(total)) * F.lit(float(resolution)))
        rows = groups.where(inside).groupBy(rung.alias("rung")).agg(F.min("start").alias("start"), F.count("*").alias("n")).collect()
        ladder.add([(int(r["start"]), int(r["n"])) for r in rows])
        done = lambda c, step: ladder.walk(c, n_shards, step)[-1] >= ladder.total
        possible = _least(low, high, lambda c: done(c, ladder.reach))
        certain = _least(low, high, lambda c: done(c, ladder.step))
        lower, upper = ladder.walk(possible, n_shards, ladder.step), ladder.walk(certain, n_shards, ladder.reach)
        if possible == certain and lower == upper:
            return certain, lower[:-1]
        low, high = possible - 1, certain
        stretches = []
        for a, b in zip(lower[1:], [*upper[1:], *[ladder.total] * len(lower)]):
            end = ladder.bounds[min(bisect_right(ladder.bounds, b), len(ladder.bounds) - 1)]
            stretches.append((a, end))
        resolution *= 64


def described(docs: DataFrame, order: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """What ``place`` needs of documents: doc_id, the columns ``keep``, size, text_crc32,
    text_hash and __ord, their place in the order."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), *keep,
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(text.cast("binary"), 256)), F.lit(b"")).alias("text_hash"),
        (F.col("doc_id") if order is None else order).cast("long").alias("__ord"),
    )


def place(base: DataFrame, n_shards: int, keep: tuple[str, ...], scratch: Scratch) -> DataFrame:
    """``base``: a written table of ``described``."""
    rows = base.count()
    groups = base.groupBy("text_hash").agg(F.min("__ord").alias("__ord"), F.sum("size").alias("bytes"), F.count("*").alias("n"))
    groups = dealt(groups, ["__ord", "text_hash"], rows, ROWS_A_BUCKET, scratch, "dealt")
    groups = running(groups, [], "__b", ["__ord", "text_hash"], {"start": F.col("bytes")})
    groups = scratch.table(groups.select("text_hash", "start", "bytes", "n"), "groups")
    capacity, starts = capacity_and_cuts(groups.select("start", "bytes"), n_shards)
    shard = F.lit(0)
    for s in starts[1:]:
        shard = shard + (F.col("start") >= s).cast("int")
    # a group that many rows are of would land in one task of a join by hash
    hot = groups.where(F.col("n") * HOT_SHARE >= rows).select(F.col("text_hash").alias("__hot"), F.col("start").alias("__start"))
    marked = base.join(F.broadcast(hot), F.col("text_hash") == F.col("__hot"), "left").drop("__hot")  # HOT_SHARE rows at most
    few = marked.where("__start is null").drop("__start").join(groups.where(F.col("n") * HOT_SHARE < rows).select("text_hash", "start"), "text_hash")
    placed = marked.where("__start is not null").withColumnRenamed("__start", "start").select(*base.columns, "start").union(few.select(*base.columns, "start"))
    placed = placed.select(*base.columns, shard.cast("int").alias("shard"), F.monotonically_increasing_id().alias("__row"))
    along = ["__ord", "doc_id", "text_hash", "__row"]
    placed = dealt(placed, ["shard", *along], rows, ROWS_A_BUCKET, scratch, "placed")
    out = running(placed, ["shard"], "__b", along, {"slot": F.lit(1).cast("long")})
    return out.select("doc_id", *keep, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.lit(capacity).cast("long").alias("capacity"), "text_hash")


def minimax_shards(docs: DataFrame, n_shards: int = 16, order: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id long, size long, text_crc32 long, law string ('bytes'), shard int, slot long,
    grown_shard int (null: this law has none), capacity long, the columns ``keep``, and
    text_hash binary (SHA-256), one row per row of ``docs`` (doc_id, text).

    ``size`` is the UTF-8 length of the text plus 1. A null text has length 0 and no
    text_crc32; all null texts are one group. ``order`` is a whole number that orders the
    documents (default doc_id); nulls come first, ties go by text hash. slot counts a
    shard's rows from 0 in that order. Repeated rows get slots of their own. With fewer
    groups than shards some shards stay empty; an empty table gives no rows. A group larger
    than an even share sets the capacity.
    """
    with Scratch(docs.sparkSession, "shards") as scratch:
        return scratch.keep(place(scratch.table(described(docs, order, keep), "base"), n_shards, keep, scratch))
