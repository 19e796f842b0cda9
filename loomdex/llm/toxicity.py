"""Toxic passages by maximum-scoring segments over token log-odds.

Fit (labelled rows outside the held-out third, at most ``per_class`` a class):

* Tokens are lower-cased words and their prefixes of 3 to 8 bytes. A token's score is the
  log ratio of its rate in toxic and in other documents under Dirichlet priors (``PRIOR``
  pseudo-counts on either side), less one standard error. Words are judged first, and what
  a kept token explains is taken out of the counts of its prefixes, so that a prefix
  stands only for what its words do not explain. Counts are capped at ``BURST`` for a
  token and document.
* A word that has no kept token scores -``DRIFT``; else the longest kept one counts.
* Lambda is the positive root of E[exp(lambda s)] = 1 over words of non-toxic training
  documents, and K the maximum-likelihood scale of the Gumbel law of their best segments
  (Karlin and Altschul), so a segment of score S in n words has E = K n exp(-lambda S).
* A document's statistic is the sum of -ln E over its segments with E < 1, made a
  probability by a logistic curve fitted on the training rows.

Scoring finds all maximal scoring segments of each whole text in one pass (Ruzzo and
Tompa), in time linear in its words.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import training_rows
from .lexer import LETTERS, U64, buffers, per_row, signed, unsigned, words
from .scratch import Scratch, fresh
from .stream import frugal

PREFIXES = (3, 4, 5, 6, 7, 8)
BURST = 4
PRIOR = 1.0
DRIFT = 0.1
MIN_DOCS = 3
MIN_SCORE = 1.0
_FILTER = 1 << 20
#: Columns of token counts: hash, level, count, documents, hashes of the prefixes (0: none).
_COUNTS = ["h", "level", "n", "docs", *(f"up{p}" for p in PREFIXES)]


@dataclass
class ToxicityModel:
    tokens: np.ndarray  # sorted uint64 hashes
    scores: np.ndarray
    lam: float = 1.0
    k: float = 1.0
    weight: float = 1.0
    bias: float = -3.0

    def seen(self) -> np.ndarray:
        out = np.zeros(_FILTER, dtype=bool)
        out[(self.tokens & U64(_FILTER - 1)).astype(np.int64)] = True
        return out


def _lookup(model: ToxicityModel, seen: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of known hashes and their scores."""
    at = np.flatnonzero(seen[(h & U64(_FILTER - 1)).astype(np.int64)])
    if not len(at):
        return at, np.zeros(0)
    where = np.minimum(np.searchsorted(model.tokens, h[at]), len(model.tokens) - 1)
    hit = model.tokens[where] == h[at]
    return at[hit], model.scores[where[hit]]


def word_scores(model: ToxicityModel, seen: np.ndarray, w) -> np.ndarray:
    """Score of each word, 0 where no token of it is kept (the drift is added later)."""
    out = np.zeros(len(w))
    if not len(model.tokens):
        return out
    length = w.end - w.start
    for p in PREFIXES:
        at, score = _lookup(model, seen, w.prefix[p])
        longer = length[at] > p
        out[at[longer]] = score[longer]
    at, score = _lookup(model, seen, w.hash)
    out[at] = score
    return out


def maximal_segments(place: np.ndarray, score: np.ndarray, drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first index, last index, score) of a sequence that
    scores ``score[i] > 0`` at ``place[i]`` (ascending) and -drift elsewhere.

    Each candidate keeps a link to the nearest earlier one whose left sum is lower, so the
    search back skips what can't match and the whole is linear.
    """
    left: list[float] = []
    right: list[float] = []
    first: list[int] = []
    last: list[int] = []
    link: list[int] = []
    gained = 0.0
    for i in range(len(place)):
        l = gained - drift * (int(place[i]) - i)
        gained += float(score[i])
        r = gained - drift * (int(place[i]) - i)
        lo = i
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= l:
                j = link[j]
            if j < 0 or right[j] >= r:
                left.append(l)
                right.append(r)
                first.append(lo)
                last.append(i)
                link.append(j)
                break
            l, lo = left[j], first[j]
            del left[j:], right[j:], first[j:], last[j:], link[j:]
    return [(f, e, r - l) for f, e, l, r in zip(first, last, left, right)]


def statistic(model: ToxicityModel, n: int, segments: list[tuple[int, int, float]]) -> tuple[float, list[float]]:
    """Sum of -ln E over significant segments, and -ln E of each segment."""
    base = math.log(model.k * max(n, 1))
    surprise = [model.lam * s - base for _, _, s in segments]
    return sum(x for x in surprise if x > 0), surprise


def probability(model: ToxicityModel, t: float) -> float:
    z = model.weight * math.log1p(t) + model.bias
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def _features(w, lo: int, hi: int):
    """Per row: distinct tokens (hash, level, count up to BURST, hashes of its prefixes)."""
    at, length = per_row(w.row, lo, hi), w.end - w.start
    for r in range(lo, hi):
        s = slice(at[r - lo], at[r - lo + 1])
        if s.start == s.stop:
            yield np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros((0, len(PREFIXES)), dtype=U64)
            continue
        heads = np.stack([w.prefix[p][s] for p in PREFIXES], axis=1)
        heads[np.asarray(PREFIXES)[None, :] >= length[s][:, None]] = 0  # no proper prefix
        h, level, up = [w.hash[s]], [np.full(s.stop - s.start, 99)], [heads]
        for i, p in enumerate(PREFIXES):
            has = heads[:, i] != 0
            mine = heads[has].copy()
            mine[:, i:] = 0
            h.append(heads[has, i])
            level.append(np.full(int(has.sum()), p))
            up.append(mine)
        h, level, up = np.concatenate(h), np.concatenate(level), np.concatenate(up)
        u, index, n = np.unique(h, return_index=True, return_counts=True)
        yield u, level[index], np.minimum(n, BURST), up[index]


def _toxic_counts(batches, most: int = 1 << 17):
    """Counts of tokens. Rows of documents are merged whenever ``most`` of them are held, and
    handed on once merging frees less than half."""
    held, size, total = [], 0, 0

    def merged() -> tuple[np.ndarray, ...]:
        h, level, n, docs, up = (np.concatenate(x) for x in zip(*held))
        h, first, at = np.unique(h, return_index=True, return_inverse=True)
        return h, level[first], np.bincount(at, n).astype(np.int64), np.bincount(at, docs).astype(np.int64), up[first]

    def counted(words_: int, h=(), level=(), n=(), docs=(), up=None) -> pa.RecordBatch:
        """The tokens, and the number of words as a row of level -1."""
        up = np.zeros((0, len(PREFIXES)), dtype=U64) if up is None else up
        columns = [[0, *signed(np.asarray(h, dtype=U64))], [-1, *level], [words_, *n], [0, *docs], *([0, *signed(up[:, i])] for i in range(len(PREFIXES)))]
        return pa.RecordBatch.from_arrays([pa.array(np.array(c, dtype=np.int64)) for c in columns], names=_COUNTS)

    for batch in batches:
        for lo, hi, w in words(batch.column("text"), LETTERS, PREFIXES):
            total += len(w)
            for h, level, n, up in _features(w, lo, hi):
                held.append((h, level, n, np.ones(len(h), dtype=np.int64), up))
                size += len(h)
                if size >= most:
                    held = [merged()]
                    size = len(held[0][0])
                    if size >= most // 2:
                        yield counted(total, *held[0])
                        held, size, total = [], 0, 0
    yield counted(total, *merged()) if held else counted(total)


def _other_counts(tokens: np.ndarray):
    def run(batches):
        seen = np.zeros(_FILTER, dtype=bool)
        seen[(tokens & U64(_FILTER - 1)).astype(np.int64)] = True
        count, total = np.zeros(len(tokens), dtype=np.int64), 0
        for batch in batches:
            for lo, hi, w in words(batch.column("text"), LETTERS, PREFIXES):
                total += len(w)
                for h, _, n, _ in _features(w, lo, hi):
                    at = np.flatnonzero(seen[(h & U64(_FILTER - 1)).astype(np.int64)])
                    where = np.minimum(np.searchsorted(tokens, h[at]), len(tokens) - 1)
                    hit = tokens[where] == h[at]
                    count[where[hit]] += n[at[hit]]
        kept = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *kept.tolist()], pa.int64()), pa.array([total, *count[kept].tolist()], pa.int64())], names=["i", "n"])

    return run


def _segments(model: ToxicityModel):
    """Of each row its class, words, scores of its maximal segments and, for class 0, scores of its words."""

    def run(batches):
        seen = model.seen()
        for batch in batches:
            label, n, best, scores = batch.column("y").to_pylist(), [], [], []
            for lo, hi, w in words(batch.column("text"), LETTERS, PREFIXES):
                at, score = per_row(w.row, lo, hi), word_scores(model, seen, w)
                for r in range(lo, hi):
                    s = score[at[r - lo] : at[r - lo + 1]]
                    p = np.flatnonzero(s)
                    n.append(len(s))
                    best.append([x for _, _, x in maximal_segments(p, s[p])])
                    scores.append(s[p].tolist() if label[r] == 0 else [])
            numbers = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(n, pa.int64()), pa.array(best, numbers), pa.array(scores, numbers)], names=["y", "n", "segments", "scores"])

    return run


def _select(toxic: dict[str, np.ndarray], words_toxic: int, other: np.ndarray, words_other: int) -> tuple[np.ndarray, np.ndarray]:
    """Kept tokens and scores; longest tokens first, each taking its counts from its prefixes."""
    h = unsigned(toxic["h"])
    n, docs, level = toxic["n"].astype(np.float64), toxic["docs"].astype(np.float64), toxic["level"]
    up = np.stack([toxic[c] for c in _COUNTS[4:]], axis=1)
    expected = other * (words_toxic / max(words_other, 1))
    index = {int(x): i for i, x in enumerate(signed(h))}
    kept, scores = [], []
    for i in np.argsort(-level, kind="stable"):
        if docs[i] < MIN_DOCS or n[i] <= expected[i]:
            continue
        s = math.log((n[i] + PRIOR) / (expected[i] + PRIOR)) - 1 / math.sqrt(docs[i] + PRIOR)
        if s < MIN_SCORE:
            continue
        kept.append(h[i])
        scores.append(s)
        for x in up[i].tolist():
            j = index.get(x) if x else None
            if j is not None:
                n[j] -= n[i]
                expected[j] = max(0.0, expected[j] - expected[i])
                docs[j] = min(docs[j], n[j])
    order = np.argsort(np.array(kept, dtype=U64))
    return np.array(kept, dtype=U64)[order], np.array(scores)[order]


def _extreme_value(model: ToxicityModel, rows: list[tuple[int, int, list, list]]) -> None:
    """Lambda and K from non-toxic rows (y, words, segments, scores)."""
    clean = [r for r in rows if r[0] == 0 and r[1] > 0]
    total = sum(r[1] for r in clean)
    values = np.array([s for r in clean for s in r[3]] + [float(model.scores.max()) if len(model.scores) else 1.0])
    p, rest = 1 / (total + 1), 1 - len(values) / (total + len(values))

    def excess(lam: float) -> float:
        return rest * math.exp(-lam * DRIFT) + p * float(np.exp(np.minimum(lam * values, 700)).sum()) - 1

    lo, hi = 1e-6, 1.0
    while excess(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if excess(mid) < 0 else (lo, mid)
    model.lam = max(hi, 0.05)
    weight = 0.0
    for _, n, segments, _ in clean:
        weight += n * math.exp(-model.lam * max(segments, default=0.0))
    model.k = len(clean) / weight if weight else 1.0


def _calibrate(model: ToxicityModel, rows, counts: dict[int, int]) -> None:
    """Logistic curve of ln(1 + statistic), each class weighted to its share of the labels."""
    t = np.array([math.log1p(statistic(model, n, [(0, 0, s) for s in segments])[0]) for _, n, segments, _ in rows])
    y = np.array([r[0] for r in rows], dtype=np.float64)
    share = {c: counts.get(c, 0) / max((y == c).sum(), 1) for c in (0, 1)}
    weight = np.where(y == 1, share[1], share[0])
    weight = weight / max(weight.sum(), 1e-9) * len(y)
    beta = np.array([0.0, 1.0])
    x = np.stack([np.ones(len(t)), t], axis=1)
    for _ in range(50):
        mu = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (y - mu)) - 0.01 * beta
        hess = (x * (weight * mu * (1 - mu))[:, None]).T @ x + 0.01 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    model.bias, model.weight = float(beta[0]), float(max(beta[1], 0.0))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 6000) -> ToxicityModel:
    """A model from ``labels`` (doc_id, toxic). Without both classes it has no tokens and
    gives every text the same score, the share of class 1 with one pseudo-count a side."""
    with Scratch(docs.sparkSession, "toxicity") as scratch:
        picked, counts = training_rows(docs, labels, "toxic", per_class)
        rows = scratch.table(picked, "rows")
        none = ToxicityModel(np.zeros(0, dtype=U64), np.zeros(0))
        share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
        none.bias, none.weight = math.log(share / (1 - share)), 0.0
        if not counts.get(0) or not counts.get(1):
            return none
        toxic = rows.where("y = 1").select("text").mapInArrow(frugal(_toxic_counts), ", ".join(f"{c} long" for c in _COUNTS))
        toxic = toxic.groupBy("h", "level").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), *[F.max(c).alias(c) for c in _COUNTS[4:]])
        got = toxic.where((F.col("docs") >= MIN_DOCS) | (F.col("level") == -1)).toArrow()  # tokens of per_class documents
        toxic = {c: got.column(c).to_numpy() for c in _COUNTS}
        is_token = toxic["level"] != -1
        words_toxic = int(toxic["n"][~is_token].sum())
        order = np.flatnonzero(is_token)
        order = order[np.argsort(unsigned(toxic["h"])[order])]
        if not len(order):
            return none
        toxic = {c: v[order] for c, v in toxic.items()}
        tokens = unsigned(toxic["h"])
        other = rows.where("y = 0").select("text").mapInArrow(frugal(_other_counts(tokens)), "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
        count = np.zeros(len(tokens))
        at, n = other.column("i").to_numpy(), other.column("n").to_numpy()
        count[at[at >= 0]] = n[at >= 0]
        words_other = int(n[at < 0].sum())
        model = ToxicityModel(*_select(toxic, words_toxic, count, words_other))
        got = rows.mapInArrow(frugal(_segments(model)), "y int, n long, segments array<double>, scores array<double>").toArrow()  # 2 x per_class rows at most
        sample = list(zip(*(got.column(c).to_pylist() for c in ("y", "n", "segments", "scores"))))
        _extreme_value(model, sample)
        _calibrate(model, sample, counts)
        return model


def _score(model: ToxicityModel, names: list[str], passages: bool):
    def run(batches):
        seen = model.seen()
        for batch in batches:
            column = batch.column("text")
            off, raw = buffers(column)
            score, found = np.zeros(batch.num_rows), []
            for lo, hi, w in words(column, LETTERS, PREFIXES):
                at, value = per_row(w.row, lo, hi), word_scores(model, seen, w)
                hits = np.flatnonzero(value)
                bound = np.searchsorted(hits, at)
                score[lo:hi] = probability(model, 0.0)
                busy = np.flatnonzero(np.diff(bound))
                spans = [[] for _ in range(hi - lo)] if passages else None
                for r in busy:
                    p = hits[bound[r] : bound[r + 1]]
                    segments = maximal_segments(p - at[r], value[p])
                    t, surprise = statistic(model, int(at[r + 1] - at[r]), segments)
                    score[lo + r] = probability(model, t)
                    if passages:
                        for (f, e, s), x in zip(segments, surprise):
                            if x > 0:
                                a, b = int(w.start[p[f]]), int(w.end[p[e]])
                                piece = raw[off[lo + r] + a : off[lo + r] + b].tobytes().decode("utf-8", "replace")
                                spans[r].append({"start": a, "end": b, "score": float(s), "surprise": float(x), "text": piece})
                if passages:
                    found += spans
            out = [batch.column(c) for c in batch.schema.names if c != "text" or "text" in names]
            out.append(pa.array(score))
            if passages:
                kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("surprise", pa.float64()), ("text", pa.string())])
                out.append(pa.array(found, pa.list_(kind)))
            yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def score(docs: DataFrame, model: ToxicityModel, keep: list[str] = ("doc_id",), passages: bool = False) -> DataFrame:
    """Columns ``keep`` of ``docs`` plus score double (0 to 1) and, if asked for, passages:
    start and end bytes, segment score, -ln E and text of each significant passage.

    No shuffle: texts stream through once. A null or empty text has no words and gets the
    score of statistic 0. Repeated rows get equal results. If ``keep`` has a column named
    score (or passages), the new one gets an underscore at its end.
    """
    kept = list(keep)
    base = docs.select(*kept) if "text" in kept else docs.select(*kept, F.col("text").cast("string").alias("text"))
    base = base.withColumn("text", F.col("text").cast("string"))
    name = fresh(base, "score")
    names = [*kept, name]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.select(*kept).schema.fields) + f", `{name}` double"
    if passages:
        names.append(fresh(base, "passages"))
        schema += f", `{names[-1]}` array<struct<start:bigint,end:bigint,score:double,surprise:double,text:string>>"
    return base.mapInArrow(frugal(_score(model, names, passages)), schema)
