"""Language of a text as a mixture of the learned languages.

A language is a smoothed distribution over character trigrams (letters lower-cased, all else a
space; trigrams are hashed into a table of fixed size, so a model holds ``BUCKETS`` numbers a
language). A document is a mixture: expectation-maximisation estimates the share of each
language from the likelihoods of the document's trigrams, over whole texts. Languages are then
dropped one at a time, the smallest share first, and the set with the best likelihood less a
penalty per language (BIC; trigrams overlap threefold, hence ``PENALTY``) is kept.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 1 << 16
SMOOTH = 0.5
PENALTY = 3.0
STEPS = 8
_CHUNK = 400_000   # characters worked on at once

_FOLD: np.ndarray | None = None


def _fold_table() -> np.ndarray:
    """Code point -> its lower-case letter, or 0 for what is no letter."""
    t = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            t[c] = ord(low) if len(low) == 1 else c
    return t


def _codes(text: str) -> np.ndarray:
    global _FOLD
    if _FOLD is None:
        _FOLD = _fold_table()
    return _FOLD[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document index, bucket) of every trigram around a letter, and letters per document."""
    parts = [_codes(t) for t in texts]
    lens = np.array([len(p) + 2 for p in parts], np.int64)
    flat = np.zeros(int(lens.sum()) + 1, np.uint32)
    at = 1
    for p in parts:
        flat[at:at + len(p)] = p
        at += len(p) + 2
    mid = np.flatnonzero(flat[1:-1]) + 1
    doc = np.searchsorted(np.cumsum(lens), mid, side="left")
    key = ((flat[mid - 1].astype(np.uint64) << np.uint64(42)) | (flat[mid].astype(np.uint64) << np.uint64(21))
           | flat[mid + 1].astype(np.uint64))
    key *= np.uint64(0x9E3779B97F4A7C15)
    return doc, (key >> np.uint64(48)).astype(np.int64), np.bincount(doc, minlength=len(texts))


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= _CHUNK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def fit(train: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages in order, log-free probabilities by bucket and language) from all rows with
    a text and a language. Partitions count into tables of fixed size; Spark adds them up and
    at most ``BUCKETS`` numbers a language reach the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            texts, langs = b["t"].tolist(), b["l"].tolist()
            for i, j in _chunks(texts):
                doc, bucket, _ = trigrams(texts[i:j])
                names, code = np.unique(np.array(langs[i:j], object).astype(str), return_inverse=True)
                for c, name in enumerate(names):
                    got = np.bincount(bucket[code[doc] == c], minlength=BUCKETS)
                    held[name] = held[name] + got if name in held else got
        for name, got in held.items():
            at = np.flatnonzero(got)
            yield pd.DataFrame({"l": name, "b": at, "n": got[at]})

    rows = (train.filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
            .select(F.col(text).alias("t"), F.col(lang).alias("l"))
            .mapInPandas(count, "l string, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toPandas())
    names = sorted(rows["l"].unique())
    table = np.full((BUCKETS, len(names)), SMOOTH)
    table[rows["b"].to_numpy(), np.searchsorted(names, rows["l"].to_numpy().astype(str)) if names else []] += \
        rows["n"].to_numpy()
    return names, (table / table.sum(axis=0)).astype(np.float32)


def _em(theta, probs, weight, starts, doc, total, steps):
    """EM shares and log likelihood per document; rows of ``probs`` are sorted by document."""
    for step in range(steps + 1):
        mix = np.einsum("ij,ij->i", probs, theta[doc])
        if step == steps:
            return theta, np.add.reduceat(weight * np.log(np.maximum(mix, 1e-30)), starts)
        resp = probs * (weight / np.maximum(mix, 1e-30))[:, None]
        theta = theta * np.add.reduceat(resp, starts, axis=0) / total[:, None]


def mixtures(texts: list[str], probs: np.ndarray) -> np.ndarray:
    """Shares (document x language) of the chosen language set; zero rows for texts without letters."""
    out = np.zeros((len(texts), probs.shape[1]))
    for i, j in _chunks(texts):
        out[i:j] = _mixtures(texts[i:j], probs)
    return out


def _mixtures(texts, probs):
    langs = probs.shape[1]
    share = np.zeros((len(texts), langs))
    doc, bucket, letters = trigrams(texts)
    if not len(doc) or not langs:
        return share
    cells, weight = np.unique(doc * BUCKETS + bucket, return_counts=True)
    doc, bucket = cells // BUCKETS, cells % BUCKETS
    live, starts = np.unique(doc, return_index=True)
    doc = np.searchsorted(live, doc)
    weight, p = weight.astype(np.float64), probs[bucket].astype(np.float64)
    total = letters[live].astype(np.float64)
    theta = np.full((len(live), langs), 1.0 / langs)
    theta, like = _em(theta, p, weight, starts, doc, total, STEPS)
    best, best_value = theta, like - 0.5 * PENALTY * np.log(np.maximum(total, 2)) * langs
    ids = np.arange(len(live))
    for size in range(langs - 1, 0, -1):
        # drop each document's smallest share and fit the rest again from where it stands
        order = np.where(theta > 0, theta, np.inf)
        theta = theta.copy()
        theta[np.arange(len(theta)), order.argmin(axis=1)] = 0
        left = theta.sum(axis=1, keepdims=True)
        theta = np.where(left > 0, theta / np.maximum(left, 1e-300), 1.0 / langs)
        theta, like = _em(theta, p, weight, starts, doc, total, STEPS if size > 1 else 1)
        value = like - 0.5 * PENALTY * np.log(np.maximum(total, 2)) * size
        better = value >= best_value[ids]
        best[ids[better]] = theta[better]
        best_value[ids[better]] = value[better]
    share[live] = best
    return share


def predict(docs: DataFrame, names: list[str], probs: np.ndarray, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` plus lang_pred, score, languages and shares (the chosen set, largest share first).

    A null text, a text without letters and an empty model give ``und``, score 0 and empty
    arrays; equal shares go to the first language in alphabetical order.
    """
    slim = docs.select(*keep, F.col(text).alias("__text"))
    schema = (slim.drop("__text").schema.add("lang_pred", "string").add("score", "double")
              .add("languages", T.ArrayType(T.StringType())).add("shares", T.ArrayType(T.DoubleType())))
    model = docs.sparkSession.sparkContext.broadcast(probs)   # BUCKETS floats a language
    order = np.array(names, object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            share = mixtures([t or "" for t in b["__text"]], model.value)
            rank = np.argsort(-share, axis=1, kind="stable")
            sizes = (share > 0).sum(axis=1)
            out = b[keep].copy()
            out["lang_pred"] = [order[r[0]] if s else "und" for r, s in zip(rank, sizes)]
            out["score"] = np.clip(share.max(axis=1), 0, 1) if len(names) else np.zeros(len(b))
            out["languages"] = [order[r[:s]].tolist() for r, s in zip(rank, sizes)]
            out["shares"] = [x[r[:s]].tolist() for x, r, s in zip(share, rank, sizes)]
            yield out
    return slim.mapInPandas(run, schema)
