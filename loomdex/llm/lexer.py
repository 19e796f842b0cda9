"""Vectorised tokenising of Arrow string columns.

Words are found on the UTF-8 bytes with numpy: no Python object is made per word.
Texts are handled whole. Rows are grouped into pieces of about ``PIECE`` bytes, and a
longer row is cut at word ends only, so byte-sized arrays stay bounded for any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
U64 = np.uint64
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)  # splitmix64 finaliser
_BASE = U64(0x9E3779B97F4A7C15)
_LEN = U64(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * _M1
    x = (x ^ (x >> U64(27))) * _M2
    return x ^ (x >> U64(31))


def mix_int(x: int) -> int:
    return int(mix64(np.array([x & 0xFFFFFFFFFFFFFFFF], dtype=U64))[0])


_BYTE = mix64(np.arange(1, 257, dtype=U64) * _BASE) | U64(1)
_powers = np.cumprod(np.full(4096, _BASE, dtype=U64))


def _power(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        _powers = np.cumprod(np.full(max(n, 2 * len(_powers)), _BASE, dtype=U64))
    return _powers


@dataclass(frozen=True)
class Lexer:
    """``word``: which bytes belong to words; ``fold``: the byte each one counts as;
    ``latin1``: also lower-case the two-byte letters U+00C0 to U+00DE."""

    word: np.ndarray
    fold: np.ndarray
    latin1: bool = False


def _table(keep) -> np.ndarray:
    return np.array([bool(keep(b)) for b in range(256)])


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Runs of anything but blank, tab, newline, vertical tab, form feed, carriage return; A-Z lowered.
BLANK_SEPARATED = Lexer(_table(lambda b: b != 32 and not 9 <= b <= 13), _LOWER)
#: Runs of letters (every byte of a non-ASCII character counts as one), lowered.
LETTERS = Lexer(_table(lambda b: b >= 128 or 65 <= b <= 90 or 97 <= b <= 122), _LOWER, True)
#: Runs of letters and digits, lowered.
ALNUM = Lexer(_table(lambda b: b >= 128 or 65 <= b <= 90 or 97 <= b <= 122 or 48 <= b <= 57), _LOWER, True)


@dataclass
class Words:
    """Parallel arrays over the words of some rows; offsets count bytes within the row's text."""

    hash: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    prefix: dict[int, np.ndarray] = field(default_factory=dict)

    def __len__(self) -> int:
        return len(self.hash)


def _lex_piece(buf: np.ndarray, bounds: np.ndarray, lexer: Lexer, prefixes: tuple[int, ...]) -> Words:
    n = len(buf)
    is_word = lexer.word[buf]
    first = np.zeros(n + 1, dtype=bool)
    first[bounds] = True
    before = np.empty(n, dtype=bool)
    before[:1] = False
    before[1:] = is_word[:-1]
    after = np.empty(n, dtype=bool)
    after[-1:] = False
    after[:-1] = is_word[1:]
    starts = np.flatnonzero(is_word & (~before | first[:-1]))
    ends = np.flatnonzero(is_word & (~after | first[1:])) + 1
    row = np.searchsorted(bounds, starts, side="right") - 1
    if not len(starts):
        none = np.zeros(0, dtype=U64)
        return Words(none, row, starts, ends, {k: none for k in prefixes})
    folded = lexer.fold[buf]
    if lexer.latin1:
        upper = (buf >= 0x80) & (buf <= 0x9E) & (buf != 0x97)
        upper[0] = False
        upper[1:] &= buf[:-1] == 0xC3
        folded = np.where(upper, folded + np.uint8(32), folded)
    length = ends - starts
    at = np.cumsum(length) - length
    total = int(at[-1] + length[-1])
    place = np.arange(total, dtype=np.int64) - np.repeat(at, length)
    value = _BYTE[folded[is_word]] * _power(int(length.max()))[place]
    summed = np.zeros(total + 1, dtype=U64)
    np.cumsum(value, out=summed[1:])
    word_hash = mix64((summed[at + length] - summed[at]) ^ (length.astype(U64) * _LEN))
    heads = {}
    for k in prefixes:
        heads[k] = mix64((summed[at + np.minimum(length, k)] - summed[at]) ^ U64((0x5851F42D4C957F2D * k) & 0xFFFFFFFFFFFFFFFF))
    base = bounds[row]
    return Words(word_hash, row, starts - base, ends - base, heads)


def _cuts(buf: np.ndarray, lexer: Lexer) -> list[int]:
    """Ends of pieces of one long row, each right after a byte that is outside of words."""
    cuts, at, n = [0], 0, len(buf)
    while n - at > PIECE:
        end = at + PIECE
        outside = np.flatnonzero(~lexer.word[buf[at:end]])
        if len(outside):
            at += int(outside[-1]) + 1
        else:
            at = end
            while at < n:
                outside = np.flatnonzero(~lexer.word[buf[at : at + PIECE]])
                if len(outside):
                    at += int(outside[0]) + 1
                    break
                at = min(n, at + PIECE)
        cuts.append(at)
    if cuts[-1] != n:
        cuts.append(n)
    return cuts


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(len(column) + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.zeros(0, dtype=np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return off, raw


def pieces(off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about PIECE bytes, one row at least."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + PIECE, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def words(column: pa.Array, lexer: Lexer, prefixes: tuple[int, ...] = ()) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words of these rows) over all rows of the column, in order."""
    off, raw = buffers(column)
    for lo, hi in pieces(off):
        buf = raw[off[lo] : off[hi]]
        if hi - lo == 1 and len(buf) > 2 * PIECE:
            cuts = _cuts(buf, lexer)
            parts = []
            for a, b in zip(cuts, cuts[1:]):
                w = _lex_piece(buf[a:b], np.array([0, b - a]), lexer, prefixes)
                parts.append(Words(w.hash, w.row, w.start + a, w.end + a, w.prefix))
            got = Words(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("hash", "row", "start", "end")), {k: np.concatenate([p.prefix[k] for p in parts]) for k in prefixes})
        else:
            got = _lex_piece(buf, off[lo : hi + 1] - off[lo], lexer, prefixes)
        got.row = got.row + lo
        yield lo, hi, got


def per_row(row: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Bounds of each row's run in a sorted row array."""
    return np.searchsorted(row, np.arange(lo, hi + 1))


def shingles(word_hash: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the word k-grams of one text; a text of 1 to k-1 words is one shingle."""
    n = len(word_hash)
    if not n:
        return word_hash
    if n < k:
        k = n
        seed = U64(0xA0761D6478BD642F) + U64(n)
    else:
        seed = U64(0)
    out = np.full(n - k + 1, seed, dtype=U64)
    for j in range(k):
        out = (out ^ word_hash[j : n - k + 1 + j]) * _M1
        out ^= out >> U64(29)
    return mix64(out)


def shingle_set(word_hash: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one text."""
    return np.unique(shingles(word_hash, k))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.int64).view(U64)
