"""Toxicity by a support vector machine on a subsequence string kernel with Nystroem landmarks.

A text is sentences of words. A word becomes pieces of up to ``PIECE`` symbols (its letters, a start
and an end mark), each next piece ``PIECE`` / 2 symbols on, so whole words of any length count.
Between two pieces stands the gap-weighted subsequence kernel: all ``ORDER`` symbols in order within
``SPAN`` places, each place skipped costing a factor ``DECAY``, so a word with inserted letters still
shares most subsequences with the word itself. Signs and digits between letters are no places, and
letters that stand alone one after another are read as one word too. The kernel is normalised and raised to ``POWER``; two sentences' kernel is its sum over
their pieces.

Landmarks are pieces of the training texts: those that tell toxic from other documents best, their
nearest neighbours in other documents, and frequent ones. The kernel's values at them, times the
inverse root of the landmarks' own kernel matrix, are the sentence's Nystroem coordinates. On these
a squared-hinge machine is fitted by Newton steps over labelled sentences (a sentence has its
document's label); every step is one Spark aggregation. As sentences add up pieces, each word has
one number; a document's score is the logistic of how its sentences' margins and length combine,
fitted on the same documents.

The fit takes at most ``TRAIN`` documents a label, those of least hash of their id. Null and empty
texts have no sentences and get the score of such a document. Texts are never cut: sentences of
more than ``SENTENCE`` words are taken as several. Labels other than 0 and 1 take no part; with a
label missing the score is the constant (n1 + 1) / (n + 2). Columns besides those named are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_partitions, stash

THRESHOLD = 0.3
TRAIN = 6000        # documents a label
LANDMARKS = 96      # a half for toxic pieces, a quarter for their neighbours, a quarter frequent ones
CANDIDATES = 2000   # pieces that reach the driver to choose landmarks from
PIECE = 8           # symbols of a piece
ORDER = 3           # symbols of a subsequence
SPAN = 5            # places within which they stand
DECAY = 0.6
POWER = 3
ALIKE = 0.9         # a landmark has no other one as near as this
SENTENCE = 40       # words
SLIGHT = 0.25       # of the bias: sentences that rise less count as none
COST = 1.0          # of a margin's violation
NEWTON = 12
LEAST = 1e-3        # sentences whose kernel values are all below count as ones without any in the fit
DOCUMENTS = 64      # training documents taken together
AT_ONCE = 1024      # pieces whose kernel values are made together
MEMO = 200_000      # words a worker remembers
MEMO_CHARS = 24
CHUNK_CHARS = 1 << 21   # characters of texts taken together
_BREAK = "\u00b6"     # stands for a line feed among the words
_AROUND = ".,;:!?'\"()[]{}|*%&$#@-_/0123456789"    # signs around a word don't change its pieces
_START, _END, _SEP = 60, 61, 63
_TRIPLES = np.array([c for c in combinations(range(PIECE), ORDER) if c[-1] - c[0] < SPAN])


def _symbol_table() -> np.ndarray:
    """0 for a place without a symbol, 1 to 26 for a to z, 27 to 58 for other letters by code."""
    t = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(0x250):
        if chr(c).isalpha():
            t[c] = c - 96 if 97 <= c <= 122 else 27 + c % 32
    rest = np.arange(0x250, 0xE000)
    t[rest] = [27 + c % 32 if chr(c).isalpha() else 0 for c in rest]
    t[10] = _SEP
    return t


_SYMBOLS: np.ndarray | None = None


def pieces(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, symbols, places) of all pieces of lower-case words without line feeds. ``symbols``
    and ``places`` have ``PIECE`` columns; 0 marks a column without a symbol."""
    global _SYMBOLS
    if _SYMBOLS is None:
        _SYMBOLS = _symbol_table()
    sym = _SYMBOLS[np.frombuffer("\n".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
    word = np.cumsum(sym == _SEP)
    at = np.flatnonzero((sym != 0) & (sym != _SEP))
    word, sym = word[at], sym[at]
    if not len(at):
        return np.zeros(0, np.int64), np.zeros((0, PIECE), np.uint8), np.zeros((0, PIECE), np.int64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    count = np.diff(first, append=len(at))
    # the marks go around each word's letters
    n = count + 2
    start = np.cumsum(n) - n
    full = np.zeros(n.sum(), np.uint8)
    place = np.arange(len(at)) - np.repeat(first, count) + np.repeat(start, count) + 1
    full[place] = sym
    full[start], full[start + n - 1] = _START, _END
    where = np.arange(len(full))
    # pieces
    half = PIECE // 2
    many = 1 + np.maximum(0, -(-(n - PIECE) // half))
    owner = np.repeat(np.arange(len(n)), many)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    col = (start[owner] + half * nth)[:, None] + np.arange(PIECE)
    held = col < (start + n)[owner][:, None]
    col = np.minimum(col, len(full) - 1)
    return word[first][owner], np.where(held, full[col], 0), np.where(held, where[col], 0)


def subsequences(symbols: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, weight) of each piece's subsequences, a column for every choice of columns; code -1
    where there is none."""
    a, b, c = (symbols[:, _TRIPLES[:, k]].astype(np.int32) for k in range(ORDER))
    span = places[:, _TRIPLES[:, -1]] - places[:, _TRIPLES[:, 0]] + 1
    held = (c > 0) & (span <= SPAN)
    return np.where(held, (a << 12) | (b << 6) | c, -1), np.where(held, DECAY ** np.where(held, span - ORDER, 0), 0.0)


def _norms(code: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Root of each piece's kernel with itself: weights of equal subsequences are added first."""
    order = np.argsort(code, axis=1, kind="stable")
    code, run = np.take_along_axis(code, order, 1), np.cumsum(np.take_along_axis(weight, order, 1), 1)
    last = np.ones(code.shape, bool)
    last[:, :-1] = code[:, 1:] != code[:, :-1]
    before = np.where(last, run, 0.0)
    prior = np.maximum.accumulate(before, axis=1)
    total = np.where(last, run - np.concatenate([np.zeros((len(code), 1)), prior[:, :-1]], axis=1), 0.0)
    return np.sqrt((total ** 2).sum(axis=1))


@dataclass
class Landmarks:
    """Pieces with the kernel at hand; ``turn`` makes Nystroem coordinates of kernel values."""
    row: np.ndarray         # subsequence code -> row of ``table``, -1 for none
    table: np.ndarray       # rows of weights, a column a landmark, normalised; the last one is zero
    turn: np.ndarray

    @classmethod
    def of(cls, symbols: np.ndarray, places: np.ndarray) -> Landmarks:
        code, weight = subsequences(symbols, places)
        norm = _norms(code, weight)
        known = np.unique(code[code >= 0])
        row = np.full(1 << 18, -1, np.int32)
        row[known] = np.arange(len(known))
        table = np.zeros((len(known) + 1, len(symbols)), np.float32)
        piece, col = np.nonzero(code >= 0)
        np.add.at(table, (row[code[piece, col]], piece), weight[piece, col] / norm[piece])
        return cls(row, table, np.eye(len(symbols)))

    def turned(self, symbols: np.ndarray, places: np.ndarray) -> Landmarks:
        """With the inverse root of the kernel matrix of the landmarks, which are given again."""
        e, u = np.linalg.eigh(self.kernel(symbols, places).astype(float))
        keep = e > 1e-6 * max(e.max(initial=0.0), 1e-300)
        return Landmarks(self.row, self.table, u[:, keep] / np.sqrt(e[keep]))

    def kernel(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Normalised kernel, raised to ``POWER``, of each piece with each landmark."""
        out = np.zeros((len(symbols), self.table.shape[1]), np.float32)
        for lo in range(0, len(symbols), AT_ONCE):
            code, weight = subsequences(symbols[lo:lo + AT_ONCE], places[lo:lo + AT_ONCE])
            row = np.where(code >= 0, self.row[code], -1)       # the last row of the table is zero
            values = np.matmul(weight.astype(np.float32)[:, None, :], self.table[row])[:, 0]
            norm = np.maximum(_norms(code, weight), 1e-30).astype(np.float32)
            out[lo:lo + AT_ONCE] = (values / norm[:, None]) ** POWER
        return out

    def words(self, words: list[str]) -> np.ndarray:
        """Sum of the kernel values of each word's pieces."""
        owner, symbols, places = pieces(words)
        out = np.zeros((len(words), self.table.shape[1]), np.float32)
        if len(owner):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            out[owner[first]] = np.add.reduceat(self.kernel(symbols, places), first, axis=0)
        return out

    def values(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """Each word's kernel values times ``weights``."""
        owner, symbols, places = pieces(words)
        return np.bincount(owner, self.kernel(symbols, places) @ weights.astype(np.float32), minlength=len(words))


@dataclass
class Split:
    """Texts as words: ``word`` numbers into ``distinct`` (without signs around), ``sentence`` numbers rising over all
    texts, ``text`` the text of each sentence; ``count`` the words of each text."""
    distinct: list[str]
    word: np.ndarray
    sentence: np.ndarray
    text: np.ndarray
    count: np.ndarray


def split(texts: list[str | None]) -> Split:
    """Words between blanks, in lower case; sentences end at a line feed, after a word that ends
    in one of ``.!?``, or after ``SENTENCE`` words. Runs of three or more words of one letter each
    are one more word at the run's first place."""
    lists = [(t or "").lower().replace("\n", f" {_BREAK} ").split() for t in texts]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    coded = pa.array(list(chain.from_iterable(lists)), pa.string()).dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    word = coded.indices.to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(lists)), sizes)
    if not len(word):
        return Split([], word, word, word, sizes)
    is_break = np.array([w == _BREAK for w in distinct])[word]
    ends = np.array([w[-1] in ".!?" or w == _BREAK for w in distinct])[word]
    fresh = np.concatenate([[True], ends[:-1] | (text[1:] != text[:-1])])
    begin = np.flatnonzero(fresh)
    nth = np.arange(len(word)) - np.repeat(begin, np.diff(begin, append=len(word)))
    sentence = np.cumsum(fresh | (nth % SENTENCE == 0)) - 1
    of = text[np.searchsorted(sentence, np.arange(sentence[-1] + 1))]

    distinct = [w.strip(_AROUND) for w in distinct]
    single = np.array([len(w) == 1 and w.isalpha() for w in distinct])
    lone = single[word]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], lone.view(np.int8), [0]])))
    extra, places = [], []
    for a, b in zip(edge[::2], edge[1::2]):
        cuts = [a, *(a + 1 + np.flatnonzero(np.diff(text[a:b]))), b]
        for x, y in zip(cuts, cuts[1:]):
            if y - x >= 3:
                extra.append(" ".join(distinct[i] for i in word[x:y]))
                places.append(x)
    count = np.bincount(text[~is_break], minlength=len(lists))
    if extra:
        word = np.concatenate([word, len(distinct) + np.arange(len(extra))])
        sentence = np.concatenate([sentence, sentence[places]])
        distinct = distinct + extra
    return Split(distinct, word, sentence, of, count)


def _chunks(texts: list[str | None]) -> Iterator[list[str | None]]:
    part, chars = [], 0
    for t in texts:
        part.append(t)
        chars += len(t or "")
        if chars >= CHUNK_CHARS:
            yield part
            part, chars = [], 0
    if part:
        yield part


@dataclass
class Model:
    """A constant, or the landmarks with the machine and the document's logistic."""
    constant: float | None = None
    marks: Landmarks | None = None
    weights: np.ndarray | None = None      # of kernel values at the landmarks
    bias: float = 0.0
    document: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.memo: dict[str, float] = {}

    def _words(self, words: list[str]) -> np.ndarray:
        found = [self.memo.get(w) for w in words]
        new = list({w for w, v in zip(words, found) if v is None})
        values = dict(zip(new, self.marks.values(new, self.weights).tolist())) if new else {}
        if len(self.memo) + len(values) > MEMO:
            self.memo.clear()
        self.memo.update((w, v) for w, v in values.items() if len(w) <= MEMO_CHARS)
        return np.array([values[w] if v is None else v for w, v in zip(words, found)])

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """For each text: the sum of its sentences' margins beyond the bias, each from 0 to 4, and its words."""
        out = np.zeros((len(texts), 2))
        done = 0
        for part in _chunks(texts):
            s = split(part)
            if len(s.word):
                margin = np.bincount(s.sentence, self._words(s.distinct)[s.word], minlength=len(s.text))
                rise = np.clip(margin / max(-self.bias, 0.1), 0, 4)
                rise[rise < SLIGHT] = 0
                out[done:done + len(part), 0] = np.bincount(s.text, rise, minlength=len(part))
            out[done:done + len(part), 1] = s.count
            done += len(part)
        return out

    @staticmethod
    def features(evidence: np.ndarray) -> np.ndarray:
        rise, words = evidence[:, 0], evidence[:, 1]
        return np.column_stack([np.ones(len(rise)), np.log((rise + 0.3) / (words + 20)), np.log1p(rise)])

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        z = self.features(self.evidence(texts)) @ self.document
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def _training(docs: DataFrame, labels: DataFrame, key: str, text: str) -> DataFrame:
    """(label, t): at most ``TRAIN`` documents a label, those whose key has the least hash."""
    known = labels.select(F.col(key).alias("k"), F.col("label").cast("int").alias("label")).filter("k IS NOT NULL AND label IN (0, 1)")
    some = [known.filter(F.col("label") == c).orderBy(F.xxhash64(F.col("k").cast("string")), "k").limit(TRAIN) for c in (0, 1)]
    picked = some[0].unionByName(some[1])
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(picked), "k").select("label", "t")


def _piece_counts(train: DataFrame) -> DataFrame:
    """(piece, c0, c1): documents of each label that hold a piece, symbols and places as bytes."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), DOCUMENTS):
                part = b.iloc[lo:lo + DOCUMENTS]
                s = split(part["t"].tolist())
                owner, symbols, places = pieces(s.distinct)
                if not len(owner):
                    continue
                places = np.where(symbols > 0, places - places[:, :1], 0).clip(0, 255).astype(np.uint8)
                both = np.ascontiguousarray(np.hstack([symbols, places]))
                found, piece = np.unique(both.view(f"V{2 * PIECE}").ravel(), return_inverse=True)
                # distinct (document, word), then distinct (document, piece)
                held = np.unique(s.text[s.sentence] * len(s.distinct) + s.word)
                document, word = np.divmod(held, len(s.distinct))
                first = np.searchsorted(owner, np.arange(len(s.distinct) + 1))
                many = np.diff(first)[word]
                nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                pair = np.unique(np.repeat(document, many) * len(found) + piece[np.repeat(first[word], many) + nth])
                document, at = np.divmod(pair, len(found))
                label = part["label"].to_numpy()[document]
                yield pd.DataFrame({"piece": [v.tobytes() for v in found],
                                    "c0": np.bincount(at[label == 0], minlength=len(found)),
                                    "c1": np.bincount(at[label == 1], minlength=len(found))})
    return (train.mapInPandas(run, "piece binary, c0 long, c1 long").groupBy("piece")
            .agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")))


def _arrays(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 2 * PIECE)
    return both[:, :PIECE].copy(), both[:, PIECE:].astype(np.int64)


def choose_landmarks(train: DataFrame, n0: int, n1: int, count: int = LANDMARKS) -> Landmarks | None:
    counts = stash(_piece_counts(train), "pieces")
    odds = F.col("c1") * (F.log((F.col("c1") + 0.1) / (n1 + 0.2)) - F.log((F.col("c0") + 0.5) / (n0 + 1.0)))
    toxic = [bytes(r["piece"]) for r in counts.filter("c1 > 1").orderBy(odds.desc(), "piece").limit(CANDIDATES).collect()]
    plain = [bytes(r["piece"]) for r in counts.filter("c0 > 0").orderBy(F.desc("c0"), "piece").limit(CANDIDATES).collect()]
    if not toxic or not plain:
        return None
    chosen: list[bytes] = []

    def take(candidates: list[bytes], most: int) -> None:
        symbols, places = _arrays(candidates)
        code, weight = subsequences(symbols, places)
        able = np.flatnonzero(_norms(code, weight) > 0)
        if not len(able):
            return
        all_marks = Landmarks.of(symbols[able], places[able])
        near = all_marks.kernel(*_arrays(chosen)).max(axis=0) if chosen else np.zeros(len(able))
        limit, got = ALIKE ** POWER, 0
        for i, at in enumerate(able):
            if got < most and near[i] < limit:
                chosen.append(candidates[at])
                near = np.maximum(near, all_marks.kernel(symbols[at:at + 1], places[at:at + 1])[0])
                got += 1

    take(toxic, count // 2)
    if not chosen:
        return None
    heads = Landmarks.of(*_arrays(chosen))
    like = heads.kernel(*_arrays(plain)).max(axis=1)
    picked = set(chosen)
    take([plain[i] for i in np.argsort(-like, kind="stable") if plain[i] not in picked], count // 4)
    picked = set(chosen)
    take([p for p in plain if p not in picked], count - len(chosen))
    marks = _arrays(chosen)
    return Landmarks.of(*marks).turned(*marks)


def _sentences(train: DataFrame, marks: Landmarks) -> DataFrame:
    """(label, weight, x): Nystroem coordinates of the training sentences; those without any
    kernel value are one weighted row a batch and label."""
    k = marks.turn.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels = b.column(0).to_numpy()
            for lo in range(0, b.num_rows, DOCUMENTS):
                s = split(b.column(1).slice(lo, DOCUMENTS).to_pylist())
                if not len(s.text):
                    continue
                label = labels[lo:lo + DOCUMENTS][s.text]
                order = np.argsort(s.sentence, kind="stable")
                values = marks.words(s.distinct)
                first = np.flatnonzero(np.diff(s.sentence[order], prepend=-1))
                kernel = np.add.reduceat(values[s.word[order]], first, axis=0)
                some = kernel.max(axis=1) > LEAST
                x = np.vstack([kernel[some] @ marks.turn, np.zeros((2, k))])
                zero = np.bincount(label[~some], minlength=2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*label[some], 0, 1], pa.int32()), pa.array([*np.ones(len(x) - 2), *zero], pa.float64()),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(x.ravel()))],
                    names=["label", "weight", "x"])
    return train.mapInArrow(run, "label int, weight double, x array<double>").filter("weight > 0")


def fit_machine(sentences: DataFrame, k: int) -> np.ndarray:
    """Weights and bias (last) of the squared-hinge machine, by Newton steps with halving."""
    def step(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        size = (k + 1) ** 2 + k + 2

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for b in batches:
                if not b.num_rows:
                    continue
                x = np.column_stack([b.column(2).flatten().to_numpy().reshape(b.num_rows, k), np.ones(b.num_rows)])
                y = 2.0 * b.column(0).to_numpy() - 1
                slack = 1 - y * (x @ w)
                on = slack > 0
                x, y, slack, weight = x[on], y[on], slack[on], b.column(1).to_numpy()[on]
                total += np.concatenate([[(weight * slack ** 2).sum()], -2 * (x.T @ (weight * y * slack)),
                                         (2 * (x.T * weight) @ x).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["cell", "v"])
        total = np.zeros(size)
        for r in sentences.mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
            total[r["cell"]] = r["v"]
        flat = np.append(np.ones(k), 0.0)     # the bias is not shrunk
        return (0.5 * (flat * w * w).sum() + COST * total[0], flat * w + COST * total[1:k + 2],
                np.diag(flat) + COST * total[k + 2:].reshape(k + 1, k + 1))

    w = np.zeros(k + 1)
    value, gradient, hessian = step(w)
    for _ in range(NEWTON):
        move = np.linalg.solve(hessian + 1e-9 * np.eye(k + 1), -gradient)
        size = 1.0
        while True:
            new = step(w + size * move)
            if new[0] <= value or size < 1e-3:
                break
            size /= 2
        if new[0] > value:
            break
        gain, w = value - new[0], w + size * move
        value, gradient, hessian = new
        if gain <= 1e-7 * max(value, 1.0):
            break
    return w


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights with a slight ridge, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 1e-2 * w
        move = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + 1e-2 * np.eye(len(w)), g)
        w = w - move
        if np.abs(move).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """Model from the texts of ``docs`` and (key, label) rows of ``labels``."""
    train = stash(_training(docs, labels, key, text).repartition(shuffle_partitions(docs.sparkSession)), "toxic-train")
    counts = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    constant = Model(constant=(n1 + 1) / (n0 + n1 + 2))
    marks = choose_landmarks(train, n0, n1) if n0 and n1 else None
    if marks is None:
        return constant
    w = fit_machine(stash(_sentences(train, marks), "toxic-sentences"), marks.turn.shape[1])
    model = Model(marks=marks, weights=marks.turn @ w[:-1], bias=float(w[-1]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            e = model.evidence(b["t"].tolist())
            yield pd.DataFrame({"label": b["label"], "rise": e[:, 0], "words": e[:, 1]})
    known = train.mapInPandas(run, "label int, rise double, words double").toPandas()   # at most TRAIN rows a label
    model.document = _logistic(Model.features(known[["rise", "words"]].to_numpy()), known["label"].to_numpy())
    return model


def add_score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and ``score`` (0 to 1) of every whole text."""
    slim = docs.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([*slim.drop("__text").schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[keep].copy()
            out["score"] = model.score(b["__text"].tolist())
            yield out
    return slim.mapInPandas(run, schema)
