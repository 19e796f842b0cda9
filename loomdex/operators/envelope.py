"""Result envelopes: limits, truncation and how the result was found."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.planner import plan, route
from ..plans.request import SearchRequest
from .index import Index
from .search import search, summary

DEFAULT_LIMIT, HARD_LIMIT = 20, 100
# Error codes of the tool interface.
ERRORS = ("INVALID_QUERY", "INDEX_UNAVAILABLE", "REPO_NOT_FOUND", "PERMISSION_DENIED", "BACKEND_FAILURE", "TIMEOUT", "CONFIG_ERROR", "INTERNAL")


def clamp(limit: int | None) -> int:
    return min(max(DEFAULT_LIMIT if limit is None else limit, 1), HARD_LIMIT)


def envelope(index: Index, request: SearchRequest, limit: int | None = None, category: str | None = None, repeated: bool = True) -> dict:
    """version, strategy, routing_reason, counts, results, truncated. One row more than the
    limit is asked for; totals are those of the uncapped search."""
    request, n = request.checked(), clamp(limit)
    found = plan(request)
    engine, reason = route(request, found, category, True, repeated)
    all_ = search(index, replace(request, max_results=None), engine)
    order = ["relative_path"] if request.kind == "path" else ["relative_path", "line_number"]
    rows = all_.dropDuplicates(order).orderBy(*order).limit(n + 1).collect()  # limit + 1 rows
    counts = {"files_with_matches": all_.count()} if request.kind == "path" else summary(all_).first().asDict()
    return {"version": "1", "strategy": engine, "fallback_used": found.strategy == "direct_scan", "routing_reason": found.reason or reason, "counts": counts, "results": [r.asDict() for r in rows[:n]], "truncated": len(rows) > n, "cache": "miss" if engine == "indexed" else "bypass"}


def ordered_paths(hits: DataFrame, limit: int = HARD_LIMIT) -> list[str]:
    """Distinct paths in order of their first hit, the first ``limit`` of them. Hits come in
    the order of path and line unless they have a column ``ordinal``."""
    first = F.min("ordinal" if "ordinal" in hits.columns else "line_number").alias("first")
    order = ["first", "relative_path"] if "ordinal" in hits.columns else ["relative_path"]
    return [r[0] for r in hits.groupBy("relative_path").agg(first).orderBy(*order).limit(limit).collect()]
