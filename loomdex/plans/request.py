"""The search request: one fixed record, checked and normalised."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

KINDS, ENGINES, CASES = ("literal", "regex", "path", "auto"), ("indexed", "direct_scan", "auto"), ("sensitive", "insensitive")


class InvalidQuery(ValueError):
    """A request that cannot be run."""


@dataclass(frozen=True)
class SearchRequest:
    """Filters are any-of within a list and all-of across lists. ``limit_mode``: lines over
    the whole result ('global') or for each file ('per_file')."""

    pattern: str = ""
    kind: str = "auto"
    engine: str = "auto"
    case: str = "sensitive"
    path_substrings: tuple[str, ...] = ()
    path_prefixes: tuple[str, ...] = ()
    exact_paths: tuple[str, ...] = ()
    exact_names: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    globs: tuple[str, ...] = ()
    include_hidden: bool = False
    include_binary: bool = False
    max_results: int | None = None
    limit_mode: str = "global"

    def checked(self) -> "SearchRequest":
        if self.kind not in KINDS or self.engine not in ENGINES or self.case not in CASES:
            raise InvalidQuery(f"unknown kind, engine or case: {self.kind}, {self.engine}, {self.case}")
        if self.kind != "path" and not self.pattern.strip():
            raise InvalidQuery("pattern must not be empty")
        if self.max_results is not None and self.max_results < 1:
            raise InvalidQuery("max_results must be 1 at least")
        lists = {k: tuple(getattr(self, k)) for k in ("path_substrings", "path_prefixes", "exact_paths", "exact_names", "globs")}
        ext = tuple(e.lstrip(".").translate({c: c + 32 for c in range(65, 91)}) for e in self.extensions)
        return replace(self, **lists, extensions=ext)

    @property
    def effective_kind(self) -> str:
        return "literal" if self.kind == "auto" else self.kind


@dataclass
class NamedRequest:
    name: str
    request: SearchRequest = field(default_factory=SearchRequest)
