"""Signature trees over shingle sets.

Every item has a bitmap (its shingles hashed to BITS positions), a size, a class and the
number of its prefix shingles that other items have at all. A
node holds the OR of the bitmaps below it, the range of sizes, the largest surplus (how
many shingles share a bit with another one of the same set) and the range of classes.
Two sets below nodes X and Y share at most

    min(max size X, max size Y, bits(X & Y) + min(surplus X, surplus Y))

shingles, since all but ``surplus`` shingles of a set have a bit of their own. The dual
traversal drops a pair of nodes if that is less than the least overlap that sets of their
smallest sizes need, if no two sizes of theirs are near enough, or if all items below are
of one class. Items also have to have ``least_common`` prefix shingles that others share.
It never drops a pair of items that could link.
"""

from __future__ import annotations

import numpy as np

from .lexer import U64

BITS = 1024
FAN = 4
_BLOCK = 16384


def bitmap(shingle_hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITS, dtype=np.uint8)
    bits[(shingle_hashes & U64(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def least_common(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Least number of common prefix shingles of two linking sets of sizes a and b: of o
    common shingles the k-th stands at k + a - o in one order and k + b - o in the other at
    most, and both prefixes hold it while that is within their lengths."""
    o = -(-percent * (a + b) // (100 + percent))
    room = [o + (-percent * n // 100) + 1 for n in (a, b)]
    return np.maximum(np.minimum(*room), 1)


class SignatureTree:
    """Items sorted by size; levels[0] are the items, the last level is one node."""

    def __init__(self, sizes: np.ndarray, maps: np.ndarray, classes: np.ndarray, shared: np.ndarray | None = None):
        self.order = np.lexsort((classes, sizes))
        self.shared = None if shared is None else shared[self.order]
        sizes, maps, classes = sizes[self.order], maps[self.order], classes[self.order]
        surplus = sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.levels = [(sizes, sizes, maps, surplus, classes, classes)]
        while len(self.levels[-1][0]) > 1:
            lo, hi, bits, extra, first, last = self.levels[-1]
            at = np.arange(0, len(lo), FAN)
            self.levels.append(
                (
                    np.minimum.reduceat(lo, at),
                    np.maximum.reduceat(hi, at),
                    np.bitwise_or.reduceat(bits, at, axis=0),
                    np.maximum.reduceat(extra, at),
                    np.minimum.reduceat(first, at),
                    np.maximum.reduceat(last, at),
                )
            )

    def grow(self, height: int) -> None:
        while len(self.levels) < height:
            self.levels.append(self.levels[-1])


def _children(tree: SignatureTree, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First child and number of children of nodes of a level."""
    below, here = len(tree.levels[level - 1][0]), len(tree.levels[level][0])
    if below == here:  # a level that only evens out the heights
        return node, np.ones(len(node), dtype=np.int64)
    first = node * FAN
    return first, np.minimum(FAN, below - first)


def _possible(a, b, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    keep = np.zeros(len(i), dtype=bool)
    for s in range(0, len(i), _BLOCK):
        x, y = i[s : s + _BLOCK], j[s : s + _BLOCK]
        need = -(-percent * (a[0][x] + b[0][y]) // (100 + percent))
        most = np.minimum(a[1][x], b[1][y])
        ok = (100 * a[1][x] >= percent * b[0][y]) & (100 * b[1][y] >= percent * a[0][x]) & (most >= need)
        ok &= (a[4][x] != a[5][x]) | (b[4][y] != b[5][y]) | (a[4][x] != b[4][y])
        at = np.flatnonzero(ok)
        shared = np.bitwise_count(a[2][x[at]] & b[2][y[at]]).sum(axis=1, dtype=np.int64) + np.minimum(a[3][x[at]], b[3][y[at]])
        keep[s + at] = shared >= need[at]
    return keep


def dual(a: SignatureTree, b: SignatureTree | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Item pairs (index in a, index in b) that may reach ``percent`` Jaccard and are of
    different classes; ``b`` None: pairs within ``a``, each once."""
    same = b is None
    b = a if same else b
    height = max(len(a.levels), len(b.levels))
    a.grow(height)
    b.grow(height)
    i = j = np.zeros(1, dtype=np.int64)
    for level in range(height - 1, -1, -1):
        keep = _possible(a.levels[level], b.levels[level], i, j, percent)
        i, j = i[keep], j[keep]
        if not level:
            break
        ci, ni = _children(a, level, i)
        cj, nj = _children(b, level, j)
        n = ni * nj
        at = np.repeat(np.arange(len(n)), n)
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        i, j = ci[at] + k // nj[at], cj[at] + k % nj[at]
        if same:
            up = i <= j if level > 1 else i < j
            i, j = i[up], j[up]
    if a.shared is not None and b.shared is not None:
        near = np.minimum(a.shared[i], b.shared[j]) >= least_common(a.levels[0][0][i], b.levels[0][0][j], percent)
        i, j = i[near], j[near]
    if same and height == 1:
        i = j = np.zeros(0, dtype=np.int64)
    return a.order[i], b.order[j]
