"""Shape, selectivity, strategy and route of a request. Driver side, no data."""

from __future__ import annotations

from dataclasses import dataclass

from .request import SearchRequest
from .seeds import Condition, literals, of_literal, of_regex


@dataclass(frozen=True)
class Plan:
    shape: str
    selectivity: str
    strategy: str
    condition: Condition = None
    reason: str | None = None


def plan(request: SearchRequest) -> Plan:
    """Bands by bytes of the longest seed: under 3 scan, 3 to 5 medium, 6 and more high."""
    kind, insensitive = request.effective_kind, request.case == "insensitive"
    if kind == "path":
        high = len(request.pattern.encode()) >= 3 or request.exact_names
        return Plan("path", "high" if high else "medium", "path_index")
    if kind == "literal":
        condition, reason = of_literal(request.pattern, insensitive), "pattern_too_short_for_trigram_pruning"
        if condition is None and len(request.pattern.encode()) >= 3:
            reason = "non_ascii_pattern_without_case"
    else:
        condition, reason = of_regex(request.pattern, insensitive), "regex_has_no_extractable_literal_seed"
    if condition is None:
        return Plan("short_literal" if kind == "literal" else "regex_weak", "low", "direct_scan", None, reason)
    longest = max(map(len, literals(condition)))
    return Plan(kind if kind == "literal" else "regex_anchored", "high" if longest >= 6 else "medium", "indexed", condition)


def classify(files: int, size: int) -> str:
    """Corpus category by files and bytes."""
    if files > 500_000 or size > 20 << 30:
        return "very_large"
    if files >= 50_000 or size >= 2 << 30:
        return "large"
    return "medium" if files >= 5_000 or size >= 200 << 20 else "small"


def route(request: SearchRequest, found: Plan, category: str | None, index_available: bool, repeated: bool = False) -> tuple[str, str]:
    """(engine, reason). An explicit engine wins; filters on path parts and exact paths force a scan."""
    if request.kind == "path":
        return ("indexed" if index_available else "direct_scan"), "path_query"
    if request.path_substrings or request.exact_paths:
        return "direct_scan", "path_filters"
    if request.engine != "auto":
        return request.engine, "explicit_engine_override"
    if category is None:
        return ("indexed" if index_available else "direct_scan"), "repo_stats_unavailable"
    reason = f"category={category};repeated_session={repeated};strategy={found.strategy};index_available={index_available}"
    if not index_available or found.strategy == "direct_scan":
        return "direct_scan", reason
    if not repeated and (category == "small" or category == "medium" and found.selectivity == "low"):
        return "direct_scan", reason
    return "indexed", reason
