"""Document quality by regularised quadratic discriminant analysis.

Each text gives a vector of statistics (``FEATURES``), made nearly normal by logarithms
and log-odds and standardised on the training rows. Each class has a mean and a covariance
shrunk in two ways: by ``alpha`` towards the pooled covariance and by ``gamma`` towards a
multiple of the identity (Friedman's regularised discriminant). The pair is chosen by
cross-validated log loss. The Cholesky factors of both covariances are kept inverted, so a
score is two triangular products: the difference of the class log-densities, put on a
probability scale by a logistic curve fitted on cross-validated differences.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import training_rows
from .lexer import BLANK_SEPARATED, buffers, per_row, pieces, shingles, words
from .scratch import fresh
from .stream import frugal

FEATURES = (
    "log_bytes", "log_words", "letters", "upper", "digits", "blank", "stops", "marks", "bars", "bangs",
    "word_length", "word_spread", "distinct_words", "repeated_grams", "top_word", "odd_ends", "log_lines", "line_words", "repeated_lines", "high_bytes",
)


def _classes() -> np.ndarray:
    """letters 0, upper 1, digits 2, blank 3, stops 4, marks 5, bars 6, bangs 7, high bytes 8."""
    out = np.full(256, 5, dtype=np.uint8)
    out[97:123], out[65:91], out[48:58], out[128:] = 0, 1, 2, 8
    out[[32, 9, 10, 11, 12, 13]] = 3
    out[[ord(c) for c in ".,;:'\"-()?"]] = 4
    out[[ord(c) for c in "|\t"]] = 6
    out[10], out[9], out[ord("!")] = 3, 3, 7
    return out


_CLASS = _classes()
_NEWLINE = 10


def _logit(x: np.ndarray, eps: float = 2e-3) -> np.ndarray:
    return np.log((x + eps) / (1 - x + eps))


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; an empty or null text gives finite values too."""
    off, raw = buffers(column)
    n = len(off) - 1
    out = np.zeros((n, len(FEATURES)))
    size = np.diff(off).astype(np.float64)
    share = np.zeros((n, 9))
    lines, repeated_lines = np.zeros(n), np.zeros(n)
    for lo, hi in pieces(off):
        for r in range(lo, hi):
            text = raw[off[r] : off[r + 1]]
            if not len(text):
                continue
            share[r] = np.bincount(_CLASS[text], minlength=9) / len(text)
            if b"\n" not in (body := text.tobytes()):
                lines[r] = 1
                continue
            parts = [x for x in body.split(b"\n") if x.strip()]
            lines[r] = len(parts)
            total = sum(map(len, parts))
            repeated_lines[r] = 1 - sum(map(len, set(parts))) / total if total else 0
    count, length, spread = np.zeros(n), np.zeros(n), np.zeros(n)
    distinct, grams, top, odd = np.ones(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for lo, hi, w in words(column, BLANK_SEPARATED):
        at, long_ = per_row(w.row, lo, hi), (w.end - w.start).astype(np.float64)
        last = raw[off[w.row] + w.end - 1] if len(w) else np.zeros(0, dtype=np.uint8)
        strange = (_CLASS[last] >= 5) & (_CLASS[last] != 8)
        for r in range(lo, hi):
            s = slice(at[r - lo], at[r - lo + 1])
            m = s.stop - s.start
            count[r] = m
            if not m:
                continue
            length[r], spread[r] = long_[s].mean(), long_[s].std()
            _, times = np.unique(w.hash[s], return_counts=True)
            distinct[r] = math.log1p(len(times)) / math.log1p(m)
            top[r] = times.max() / (m + 5)
            g = shingles(w.hash[s], 3)
            grams[r] = 1 - len(np.unique(g)) / len(g)
            odd[r] = strange[s].mean()
    letters = share[:, 0] + share[:, 1] + share[:, 8]
    columns = [
        np.log1p(size), np.log1p(count), _logit(letters), _logit(share[:, 1] / np.maximum(letters, 1e-9)), _logit(share[:, 2]), _logit(share[:, 3]), _logit(share[:, 4]), _logit(share[:, 5]), _logit(share[:, 6]), _logit(share[:, 7]),
        np.log1p(length), np.log1p(spread), distinct, _logit(grams), _logit(top), _logit(odd), np.log1p(lines), np.log1p(count / np.maximum(lines, 1)), _logit(repeated_lines), _logit(share[:, 8]),
    ]
    for i, c in enumerate(columns):
        out[:, i] = c
    return out


@dataclass
class QualityModel:
    """factor[c] = inverse of the lower Cholesky factor of class c's covariance."""

    centre: np.ndarray
    scale: np.ndarray
    mean: np.ndarray
    factor: np.ndarray
    log_det: np.ndarray
    slope: float = 0.0
    bias: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """ln p(x | 1) - ln p(x | 0)."""
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        far = [((z - m) @ f.T) for m, f in zip(self.mean, self.factor)]
        density = [-0.5 * (d * d).sum(axis=1) - 0.5 * g for d, g in zip(far, self.log_det)]
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.bias, -700, 700)))


def discriminant(x: np.ndarray, y: np.ndarray, alpha: float, gamma: float) -> QualityModel:
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.clip((x - centre) / scale, -8, 8)
    d = x.shape[1]
    mean = np.stack([z[y == c].mean(axis=0) for c in (0, 1)])
    cov = [np.cov(z[y == c].T, bias=True) if (y == c).sum() > 1 else np.zeros((d, d)) for c in (0, 1)]
    share = [(y == c).mean() for c in (0, 1)]
    pooled = share[0] * cov[0] + share[1] * cov[1]
    factor, log_det = [], []
    for c in (0, 1):
        s = (1 - alpha) * cov[c] + alpha * pooled
        s = (1 - gamma) * s + gamma * max(np.trace(s) / d, 1e-3) * np.eye(d)
        low = np.linalg.cholesky(s + 1e-6 * np.eye(d))
        factor.append(np.linalg.inv(low))
        log_det.append(2 * np.log(np.diag(low)).sum())
    return QualityModel(centre, scale, mean, np.stack(factor), np.array(log_det))


def _logistic(t: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    spread = max(float(np.std(t)), 1e-9)
    x, beta = np.stack([np.ones(len(t)), t / spread], axis=1), np.array([0.0, 1.0])
    for _ in range(60):
        mu = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * mu * (1 - mu))[:, None]).T @ x + 0.01 * np.eye(2), x.T @ (weight * (y - mu)) - 0.01 * beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(max(beta[1], 0) / spread)


def fit_matrix(x: np.ndarray, y: np.ndarray, counts: dict[int, int], folds: int = 4) -> QualityModel:
    """The model from feature rows; ``counts`` are the labelled rows of each class, by which
    the logistic curve weighs the classes."""
    d = x.shape[1]
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    flat = QualityModel(np.zeros(d), np.ones(d), np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2), 0.0, math.log(share / (1 - share)))
    if min((y == 0).sum(), (y == 1).sum()) < 2 * folds:
        return flat
    weight = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum())
    weight = weight / weight.sum() * len(y)
    part = np.zeros(len(y), dtype=int)
    for c in (0, 1):
        part[y == c] = np.arange((y == c).sum()) % folds
    best = None
    for alpha in (0.0, 0.1, 0.3, 0.6):
        for gamma in (0.001, 0.01, 0.05, 0.2):
            t = np.zeros(len(y))
            for f in range(folds):
                t[part == f] = discriminant(x[part != f], y[part != f], alpha, gamma).difference(x[part == f])
            t = np.clip(t, *np.quantile(t, [0.005, 0.995]))
            bias, slope = _logistic(t, y, weight)
            mu = np.clip(1 / (1 + np.exp(-np.clip(slope * t + bias, -30, 30))), 1e-9, 1 - 1e-9)
            loss = -(weight * (y * np.log(mu) + (1 - y) * np.log(1 - mu))).mean()
            if best is None or loss < best[0]:
                best = loss, alpha, gamma, bias, slope
    _, alpha, gamma, bias, slope = best
    model = discriminant(x, y, alpha, gamma)
    model.bias, model.slope = bias, slope
    return model


def _feature_rows(batches):
    for batch in batches:
        x = features(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("y"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], names=["y", "x"])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 6000) -> QualityModel:
    """A model from ``labels`` (doc_id, quality), read from at most ``per_class`` rows of a
    class outside of the held-out third. Without enough rows of both classes every text
    scores the share of class 1."""
    rows, counts = training_rows(docs, labels, "quality", per_class)
    got = rows.mapInArrow(frugal(_feature_rows), "y int, x array<double>").toPandas()  # 2 x per_class rows at most
    if not len(got):
        return fit_matrix(np.zeros((0, len(FEATURES))), np.zeros(0), counts)
    x, y = np.stack(got["x"].to_numpy()), got["y"].to_numpy(dtype=np.float64)
    order = np.lexsort(np.concatenate([x.T, y[None]]))  # the fit does not depend on the order of rows
    return fit_matrix(x[order], y[order], counts)


def _score(model: QualityModel, names: list[str]):
    def run(batches):
        for batch in batches:
            out = [batch.column(c) for c in names[:-1]]
            yield pa.RecordBatch.from_arrays([*out, pa.array(model.score(features(batch.column("text"))))], names=names)

    return run


def score(docs: DataFrame, model: QualityModel, keep: list[str] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` plus score double: 1 for likely good, 0 for poor, from the whole
    text. Null and empty texts are scored by their (zero) statistics. No shuffle. A clash
    with a column named score puts an underscore to the new name."""
    kept = list(keep)
    base = docs.select(*kept) if "text" in kept else docs.select(*kept, F.col("text").cast("string").alias("text"))
    base = base.withColumn("text", F.col("text").cast("string"))
    names = [*kept, fresh(base, "score")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.select(*kept).schema.fields) + f", `{names[-1]}` double"
    return base.mapInArrow(frugal(_score(model, names)), schema)
