"""Embedding whitening by Chebyshev-filtered subspace iteration.

Vectors become integers, so counts, sums and squared deviations are exact. The leading components
of their covariance V are found without V: a block Q of a few more columns than components is
multiplied by a Chebyshev polynomial of V, scaled to damp the part of the spectrum below the block.
Every product V Q is one pass over all rows: each partition centres its rows and adds up
X' (X Q), Spark adds the partitions' cells, and d * k numbers reach the driver. After each filter
come QR and Rayleigh-Ritz; the iteration ends when every wanted Ritz pair's residual is certified
small against the largest eigenvalue. A block that stays uncertified is doubled, at most to the
dimension, where Rayleigh-Ritz is exact.

Rows with a null vector, a null or non-finite entry, or an entry whose integer passes 2^53 take no
part, nor do vectors of another length than the commonest (ties: the longest) or of length 0.
Without rows, or with all rows equal, the result is empty; components whose eigenvalue is below
``RANK`` of the largest (a constant dimension, fewer rows than dimensions) don't exist and are left
out. Equal eigenvalues leave their vectors free within the common space. Repeated rows and ids
count as often as they stand. A deviation that passes a long is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
GUARD = 16              # columns of the block beyond the components
DEGREE = 10             # most degrees of the filter, one pass each
SPREAD = 1e8            # most that a filter lifts the first pair over the damped ones
ROUNDS = 30             # filters before the block is doubled
RESIDUAL = 3e-14        # certified residual of a pair, of the largest eigenvalue
RANK = 1e-11            # an eigenvalue below so much of the largest is none
LIMIT = float(1 << 53)
ROWS = 4096             # rows turned to integers at once
_HALF = 1 << 26


def integers(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, x): which vectors take part, and floor(64 c) + 1000000 of their entries."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    places = np.flatnonzero(sizes == dim)
    flat = pc.list_flatten(column.take(pa.array(places)))
    c = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(places), dim)   # nulls become nan
    with np.errstate(invalid="ignore", over="ignore"):
        c = np.floor(SCALE * c)
        good = (np.abs(c) <= LIMIT).all(axis=1)
    return places[good], c[good].astype(np.int64) + SHIFT


def _blocks(batches: Iterator[pa.RecordBatch], at: int, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for b in batches:
        for lo in range(0, b.num_rows, ROWS):
            part = b.slice(lo, ROWS)
            places, x = integers(part.column(at), dim)
            if len(places):
                yield part, places, x


def _sums(vectors: DataFrame, cells: Callable[[np.ndarray], np.ndarray], dim: int, size: int, kind: str) -> np.ndarray:
    """Sum over all rows of ``cells``(block of rows), a flat array of ``size`` numbers."""
    dtype = np.int64 if kind == "long" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype)
        for _, _, x in _blocks(batches, 0, dim):
            total += cells(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["cell", "v"])
    rows = (vectors.mapInArrow(run, f"cell long, v {kind}").groupBy("cell")
            .agg(F.sum(F.col("v").cast("decimal(38,0)") if kind == "long" else F.col("v")).alias("v")).collect())
    out = np.zeros(size, object if kind == "long" else np.float64)
    for r in rows:
        out[r["cell"]] = int(r["v"]) if kind == "long" else r["v"]
    return out


@dataclass
class Centre:
    """Exact count and sums of the integer vectors."""
    n: int
    sums: list[int]

    @property
    def dim(self) -> int:
        return len(self.sums)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, the mean's whole part taken off exactly and its rest as a double."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole) - rest

    def squared(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2 for each row, exact; None beyond a long."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], np.int64)
        d = x - whole
        most = self.n * (int(np.abs(d).max(initial=0)) + 1)
        if self.dim * most * most < 1 << 63:
            d = self.n * d - rest
            return (d * d).sum(axis=1).tolist()
        exact = ((self.n * d.astype(object) - rest.astype(object)) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in exact]


def centre(vectors: DataFrame) -> Centre | None:
    """Count and per-dimension sums of the vectors that take part; None without any."""
    name = vectors.columns[0]
    sizes = (vectors.groupBy(F.size(name).alias("d")).count().filter("d > 0")
             .orderBy(F.desc("count"), F.desc("d")).limit(1).collect())
    if not sizes:
        return None
    dim = sizes[0]["d"]

    def cells(x: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x)], (x // _HALF).sum(axis=0), (x % _HALF).sum(axis=0)])
    total = _sums(vectors, cells, dim, 1 + 2 * dim, "long")
    n = int(total[0])
    return Centre(n, [int(h) * _HALF + int(low) for h, low in zip(total[1:1 + dim], total[1 + dim:])]) if n else None


@dataclass
class Basis:
    """Unit components (columns) and eigenvalues, falling; the trace; passes made; whether certified."""
    components: np.ndarray
    values: np.ndarray
    trace: float
    passes: int
    certified: bool


def leading(dim: int, wanted: int, product: Callable[[np.ndarray], np.ndarray], trace: float,
            guard: int = GUARD, seed: int = 7) -> Basis:
    """Leading eigenpairs of a positive matrix of which only ``product``(Q) = V Q is at hand."""
    wanted = min(wanted, dim)
    width, passes = min(dim, wanted + guard), 0
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((dim, width)))[0]
    while True:
        for _ in range(ROUNDS):
            vq = product(q)
            passes += 1
            small = q.T @ vq
            e, u = np.linalg.eigh((small + small.T) / 2)
            e, u = e[::-1], u[:, ::-1]
            q, vq = q @ u, vq @ u
            top = max(e[0], 0.0)
            real = e > RANK * top if top > 0 else np.zeros(len(e), bool)
            residual = np.sqrt(((vq - q * e) ** 2).sum(axis=0))
            done = top <= 0 or bool((residual[:wanted][real[:wanted]] <= RESIDUAL * top).all()) or width == dim
            if done:
                keep = np.flatnonzero(real[:wanted])
                return Basis(q[:, keep], e[keep], trace, passes, top <= 0 or bool((residual[keep] <= RESIDUAL * top).all()))
            # T_m of (V - c) / h, the damped interval [0, e_last] mapped to [-1, 1], scaled at e_1
            cut = max(float(e[-1]), RANK * top)
            c = h = cut / 2
            grow = h / (top - c)
            # the filter may lift the first pair over the last only so far that doubles still tell them apart
            degree = int(np.clip(np.arccosh(SPREAD) / np.arccosh(max(1 / grow, 1 + 1e-12)), 1, DEGREE))
            scale = grow
            y_old, y = q, (vq - c * q) * (grow / h)
            for _ in range(2, degree + 1):
                scale_new = 1.0 / (2.0 / grow - scale)
                vy = product(y)
                passes += 1
                y_old, y = y, (vy - c * y) * (2 * scale_new / h) - (scale * scale_new) * y_old
                scale = scale_new
            q = np.linalg.qr(y)[0]
        wider = min(dim, 2 * width)
        q = np.linalg.qr(np.hstack([q, rng.standard_normal((dim, wider - width))]))[0]
        width = wider


def fit(vectors: DataFrame, mid: Centre, components: int = COMPONENTS) -> Basis:
    """Components of the covariance (divisor n) of the one column of ``vectors``."""
    dim = mid.dim

    def product(q: np.ndarray) -> np.ndarray:
        def cells(x: np.ndarray) -> np.ndarray:
            y = mid.deviations(x)
            return (y.T @ (y @ q)).ravel()
        return _sums(vectors, cells, dim, dim * q.shape[1], "double").reshape(dim, -1) / mid.n

    trace = _sums(vectors, lambda x: np.array([(mid.deviations(x) ** 2).sum()]), dim, 1, "double")[0] / mid.n
    return leading(dim, components, product, float(trace))


def identity_error(vectors: DataFrame, mid: Centre, basis: Basis) -> float:
    """Largest absolute entry of the whitened rows' covariance (divisor n, centred) minus the identity."""
    k = len(basis.values)
    if not k:
        return 0.0
    turn = basis.components / np.sqrt(basis.values)
    mean = _sums(vectors, lambda x: (mid.deviations(x) @ turn).sum(axis=0), mid.dim, k, "double") / mid.n

    def cells(x: np.ndarray) -> np.ndarray:
        w = mid.deviations(x) @ turn - mean
        return (w.T @ w).ravel()
    cov = _sums(vectors, cells, mid.dim, k * k, "double").reshape(k, k) / mid.n
    return float(np.abs(cov - np.eye(k)).max())


def whiten(df: DataFrame, key: str, vector: str, components: int = COMPONENTS) -> DataFrame:
    """One row for each row that takes part and component: the key, component, n, deviation,
    whitened, explained, identity_error, residual_certified."""
    slim = df.select(F.col(vector).alias("v"), F.col(key).alias("k"))
    only = slim.select("v")
    mid = centre(only)
    schema = (f"`{key}` {df.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, "
              "explained double, identity_error double, residual_certified boolean")
    if mid is None:
        return df.sparkSession.createDataFrame([], schema)
    basis = fit(only, mid, components)
    error = identity_error(only, mid, basis)
    k = len(basis.values)
    turn = basis.components / np.sqrt(basis.values)
    explained = basis.values / basis.trace if k else basis.values
    names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error", "residual_certified"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, places, x in _blocks(batches, 0, mid.dim):
            m = len(places)
            rows = pa.array(np.repeat(places, k))
            yield pa.RecordBatch.from_arrays([
                part.column(1).take(rows), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, mid.n)), pa.array(mid.squared(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array((mid.deviations(x) @ turn).ravel()), pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, error)), pa.array(np.full(m * k, basis.certified))], names=names)
    return slim.mapInArrow(run, schema)
