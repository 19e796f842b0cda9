"""Scalar functions as column expressions (JVM side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Words that a goal's search terms leave out, and words that mark a defect.
STOP_WORDS = (
    "the", "and", "for", "with", "from", "into", "this", "that", "what", "where", "when", "why",
    "how", "can", "our", "your", "their", "fix", "add", "make", "use", "using",
)
BUGFIX_TERMS = ("bug", "bugfix", "fix", "panic", "error", "fail", "failing", "crash")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only; ``lower`` would also change other letters."""
    return F.translate(c, UPPER, LOWER)


def lines(text: Column) -> Column:
    """Lines without their ends; an end at the very end opens no line, an empty text has none."""
    parts = F.split(text, "\r?\n")
    return F.when(text == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def regex_column(line: Column, pattern: str) -> Column:
    """1-based byte column of the leftmost match, zero-width ones included."""
    return F.octet_length(F.regexp_extract(line, f"^((?s:.*?))(?:{pattern})", 1)) + 1


def literal_column(line: Column, pattern: str) -> Column:
    return F.octet_length(F.substring_index(line, pattern, 1)) + 1


def trim_preview(c: Column, most: int) -> Column:
    t = F.regexp_replace(c, "[\\r\\n]+$", "")
    return F.when(F.char_length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, max(most - 1, 0)), F.lit("…")))


def truncate_middle(c: Column, most: int) -> Column:
    if most <= 1:
        return F.when(F.char_length(c) <= most, c).otherwise(F.lit("…"))
    left = (most - 1) // 2
    return F.when(F.char_length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, left), F.lit("…"), F.right(c, F.lit(most - 1 - left))))


def _one_decimal(x: Column) -> Column:
    """Ties go to the even digit; sizes over powers of two are exact, so no other rounding occurs."""
    return F.format_string("%.1f", F.bround(x, 1))


def format_bytes(n: Column, binary_units: bool = False) -> Column:
    """1023 B, 1.0 KB ... GB; with ``binary_units`` KiB ... TiB."""
    units = ["B", "KiB", "MiB", "GiB", "TiB"] if binary_units else ["B", "KB", "MB", "GB"]
    out = F.concat(n.cast("string"), F.lit(" B"))
    for i, u in enumerate(units[1:], 1):
        out = F.when(n >= 1024**i, F.concat(_one_decimal(n / float(1024**i)), F.lit(f" {u}"))).otherwise(out)
    return out


def format_duration(millis: Column) -> Column:
    return F.when(millis >= 1000, F.format_string("%.2f s", millis / 1000.0)).otherwise(F.concat(millis.cast("string"), F.lit(" ms")))


def format_number(n: Column) -> Column:
    return F.format_number(n, 0)


def tokens_by_bytes(c: Column, per: float) -> Column:
    """ceil(bytes / per): 3.5 for reads, 4 for hydration payloads."""
    return F.ceil(F.octet_length(c) / F.lit(float(per)))


def tokens_by_chars(c: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.ceil(F.char_length(c) / F.lit(4.0)))


def round_score(c: Column) -> Column:
    """One decimal, halves away from zero."""
    return F.round(c, 1)


def decay(seconds: Column, half_life: float = 604800.0) -> Column:
    return F.pow(F.lit(2.0), -F.greatest(seconds, F.lit(0)) / F.lit(half_life))


def terms(goal: Column) -> Column:
    """Distinct search terms in order: runs of A-Z, a-z, 0-9 and _, of three at least, no stop words."""
    words = F.split(ascii_lower(goal), "[^a-z0-9_]+")
    return F.array_distinct(F.filter(words, lambda w: (F.char_length(w) >= 3) & ~w.isin(*STOP_WORDS)))


def is_bugfix_term(c: Column) -> Column:
    return c.isin(*BUGFIX_TERMS)


def _any(c: Column, parts: list[str], ends: list[str] = ()) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    for e in ends:
        out = out | c.endswith(e)
    return out


def looks_like_test(path: Column) -> Column:
    return _any(path, ["/test", "tests/", "_test.", ".test.", "_spec.", ".spec."])


def looks_like_config(path: Column) -> Column:
    return _any(path, ["config"], [".toml", ".yaml", ".yml"])


def looks_like_fixture(path: Column) -> Column:
    return _any(path, ["fixture", "fixtures/", "testdata"])


def normalize_path(path: Column) -> Column:
    """Without blanks around and leading ./"""
    return F.regexp_replace(F.trim(path), "^(\\./)+", "")


def normalize_line_text(c: Column) -> Column:
    """Without the carriage returns that it ends with."""
    return F.rtrim(c, F.lit("\r"))


def line_range(text: Column, first: Column, last: Column) -> Column:
    """Lines first..last (1-based, inclusive), joined by newlines."""
    all_ = lines(text)
    return F.array_join(F.slice(all_, first, F.greatest(F.least(last, F.size(all_)) - first + 1, F.lit(0))), "\n")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(ascii_lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def recommendation(stale: Column, current: Column, before: Column) -> Column:
    """skip_reread, reread_with_diff (the size moved by less than a tenth) or reread."""
    near = (F.abs(current - before) / before) < 0.10
    return F.when(~stale, "skip_reread").when(current.isNotNull() & (before > 0) & near, "reread_with_diff").otherwise("reread")
