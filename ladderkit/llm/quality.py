"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each document becomes a short vector of statistics of its whole text (lengths, shares of
character classes, repetition). Per class the mean and covariance come from sums that Spark
aggregates over the labelled rows; covariances are shrunk towards the pooled one and towards a
scaled identity. The score is the logistic of the difference of the two Gaussian log densities
(Mahalanobis distances through Cholesky factors that are computed once) plus the log prior.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

THRESHOLD = 0.7
POOL = 0.1       # weight of the pooled covariance
RIDGE = 0.02     # weight of the scaled identity
FEATURES = ["chars", "words", "word_length", "word_length_sd", "upper", "digit", "mark", "symbol", "space",
            "distinct", "top_word", "line_chars", "line_repeat", "marked_words", "letterless_words",
            "sentence_words"]
_SENTENCE = ".,;:?'\"()-"


def _class_table() -> np.ndarray:
    """0 other, 1 lower or caseless letter, 2 upper, 3 digit, 4 sentence mark, 5 symbol, 6 space."""
    t = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(0x3000):
        ch = chr(c)
        t[c] = (6 if ch.isspace() else 2 if ch.isupper() else 1 if ch.isalpha() else 3 if ch.isdigit()
                else 4 if ch in _SENTENCE else 5)
    t[0x3000:] = 1
    return t


_CLASSES: np.ndarray | None = None


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text; null counts as empty, whose shares are 0."""
    global _CLASSES
    if _CLASSES is None:
        _CLASSES = _class_table()
    text = text or ""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _CLASSES[codes]
    n = np.bincount(kinds, minlength=7).astype(float)
    chars, solid = max(1, len(codes)), max(1.0, len(codes) - n[6])
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    counts = Counter(words)
    w = max(1, len(words))
    solid_at = np.flatnonzero(kinds != 6)
    ends = solid_at[np.flatnonzero(np.diff(solid_at, append=len(codes) + 2) > 1)] if len(solid_at) else solid_at
    starts = solid_at[np.flatnonzero(np.diff(solid_at, prepend=-2) > 1)] if len(solid_at) else solid_at
    sizes = (ends - starts + 1).astype(float)
    marked = float((kinds[ends] == 5).sum()) if len(ends) else 0.0
    letters = (kinds == 1) | (kinds == 2)
    with_letter = len(np.unique(np.searchsorted(starts, np.flatnonzero(letters), "right"))) if len(starts) else 0
    sentences = float((codes == 46).sum())

    def share(x: float, of: float) -> float:
        p = min(1.0, max(0.0, x / of))
        return float(np.log((p + 0.01) / (1.01 - p)))

    return [float(np.log1p(len(codes))), float(np.log1p(len(words))),
            float(np.log1p(sizes.mean())) if len(sizes) else 0.0,
            float(np.log1p(sizes.std())) if len(sizes) else 0.0,
            share(n[2], max(1.0, n[1] + n[2])), share(n[3], solid), share(n[4], solid), share(n[5], solid),
            share(n[6], chars), share(len(counts), w) if words else 0.0,
            share(max(counts.values()), w) if words else 0.0,
            float(np.log1p(len(codes) / max(1, len(lines)))),
            share(len(lines) - len(set(lines)), max(1, len(lines))),
            share(marked, w), share(len(starts) - with_letter, w),
            float(np.log1p(len(words) / (1.0 + sentences)))]


def add_statistics(docs: DataFrame, keep: list[str], text: str = "text", col: str = "stats") -> DataFrame:
    """``keep`` columns of ``docs`` plus the statistics of ``text`` as an array of doubles."""
    slim = docs.select(*keep, F.col(text).alias("__text"))
    schema = slim.drop("__text").schema.add(col, T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[keep].copy()
            out[col] = [statistics(t) for t in b["__text"]]
            yield out
    return slim.mapInPandas(run, schema)


@dataclass
class Model:
    """Means, Cholesky factors and log prior odds; ``constant`` replaces them where a class is missing."""
    mean: np.ndarray
    factor: np.ndarray
    log_det: np.ndarray
    log_odds: float
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        density = []
        for c in (0, 1):
            z = np.linalg.solve(self.factor[c], (x - self.mean[c]).T)
            density.append(-0.5 * ((z ** 2).sum(axis=0) + self.log_det[c]))
        d = np.clip(density[1] - density[0] + self.log_odds, -700, 700)
        return 1.0 / (1.0 + np.exp(-d))


def fit(labelled: DataFrame, col: str = "stats", label: str = "label") -> Model:
    """Fit on rows with a 0/1 label. Rows with another or no label take no part.

    Every partition turns its rows into sums of x and x x' per class; Spark adds them up and
    only 2 (1 + d + d^2) numbers reach the driver. With fewer than two rows of a class the
    model is the constant (n1 + 1) / (n + 2).
    """
    d = len(FEATURES)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, 1 + d + d * d))
        for b in batches:
            for c in (0, 1):
                rows = b.loc[b[label] == c, col]
                if len(rows):
                    x = np.array(rows.tolist())
                    sums[c] += np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
        at = np.arange(sums.shape[1])
        yield pd.DataFrame({"c": np.repeat([0, 1], len(at)), "i": np.tile(at, 2), "v": sums.ravel()})

    rows = (labelled.select(F.col(col), F.col(label).cast("int").alias(label))
            .mapInPandas(moments, "c int, i int, v double").groupBy("c", "i").agg(F.sum("v").alias("v")).collect())
    sums = np.zeros((2, 1 + d + d * d))
    for r in rows:
        sums[r["c"], r["i"]] = r["v"]
    n = sums[:, 0]
    if n.min() < 2:
        return Model(np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2), 0.0, float((n[1] + 1) / (n.sum() + 2)))
    mean = sums[:, 1:1 + d] / n[:, None]
    cov = np.stack([sums[c, 1 + d:].reshape(d, d) / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)])
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
    scale = np.maximum(np.diag(pooled), 1e-6)
    cov = (1 - POOL) * cov + POOL * pooled
    cov = (1 - RIDGE) * cov + RIDGE * np.diag(scale)
    factor = np.stack([np.linalg.cholesky(c) for c in cov])
    log_det = np.array([2 * np.log(np.diag(f)).sum() for f in factor])
    return Model(mean, factor, log_det, float(np.log(n[1] / n[0])))


def add_score(rows: DataFrame, model: Model, keep: list[str], col: str = "stats") -> DataFrame:
    """``keep`` columns plus ``score`` (0 to 1); the model is a few kilobytes and goes along with the tasks."""
    schema = rows.select(*keep).schema.add("score", "double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[keep].copy()
            out["score"] = model.score(np.array(b[col].tolist())) if len(b) else np.zeros(0)
            yield out
    return rows.mapInPandas(run, schema)
