"""Row keys as filters that Parquet prunes folders and pages by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: So many rows are looked up by their keys instead of a join, in so many ranges a segment.
LOOKUP, RANGES = 4096, 64


def spans(ids: list[int], most: int = RANGES) -> list[tuple[int, int]]:
    """At most so many ranges that hold sorted ids, cut at the widest gaps."""
    gaps = sorted(range(1, len(ids)), key=lambda i: ids[i - 1] - ids[i])[: most - 1]
    cuts = [0, *sorted(gaps), len(ids)]
    return [(ids[a], ids[b - 1]) for a, b in zip(cuts, cuts[1:])]


def ranges(keys: list[tuple[int, int]]) -> Column:
    """The rows (segment, doc_id) of ``keys``; segments are folders, doc_ids sorted in pages."""
    by: dict[int, list[int]] = {}
    for segment, doc_id in keys:
        by.setdefault(segment, []).append(doc_id)
    parts = []
    for segment, ids in by.items():
        ids = sorted(set(ids))
        within = " OR ".join(f"doc_id BETWEEN {a} AND {b}" for a, b in spans(ids))
        parts.append(f"(segment = {segment} AND ({within}) AND doc_id IN ({', '.join(map(str, ids))}))")
    return F.expr(" OR ".join(parts)) if parts else F.lit(False)
