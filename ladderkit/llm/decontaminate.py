"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are sequences of word hashes (A-Z lower-cased, ASCII punctuation
counts as blank). Runs of ``SEED`` words are the seeds. A document's seeds that pass a bit table of the
items' seeds (two bits a seed, fixed size; false passes only cost a row) are joined with the items' seeds over the
shuffle. For each pair that shares a seed, the longest common runs of still unmarked words are
marked again and again, found by Karp-Rabin hashes of windows of falling length. An item is held
in a document when the marked words cover ``COVER`` of it, in whatever order the parts stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash
from .shingles import PLAIN, shingles, words

SEED = 5
COVER = 0.5
TABLE_BITS = 1 << 23
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _prefix(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial hashes and powers, so that any window's Karp-Rabin hash is one step."""
    n = len(tokens)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _MUL, np.uint64)]), dtype=np.uint64)
    return np.concatenate([[np.uint64(0)], np.cumsum(tokens * powers[:n], dtype=np.uint64)]), powers


def _windows(run: tuple[np.ndarray, np.ndarray], marked: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the unmarked windows of ``size`` tokens, hashes scaled to one power."""
    sums, powers = run
    n = len(marked)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    taken = np.concatenate([[0], np.cumsum(marked)])
    at = np.flatnonzero(taken[size:] == taken[:-size])
    return at, (sums[at + size] - sums[at]) * powers[n - at]


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: (place in doc, place in item, length), longest first, ties to the earliest
    place in the item and then in the document, each token in one tile, none shorter than ``least``."""
    n, m = len(doc), len(item)
    # one scale for both: hashes of a window are brought to the power of the longer sequence
    size = max(n, m)
    pad = lambda x: _prefix(np.concatenate([x, np.zeros(size - len(x), np.uint64)]))
    runs = pad(doc), pad(item)
    marks = np.ones(size, bool), np.ones(size, bool)
    marks[0][:n] = False
    marks[1][:m] = False
    out: list[tuple[int, int, int]] = []

    def common(length: int):
        a, ha = _windows(runs[0], marks[0], length)
        b, hb = _windows(runs[1], marks[1], length)
        if not len(a) or not len(b):
            return None
        order = np.argsort(hb, kind="stable")
        b, hb = b[order], hb[order]
        left = np.searchsorted(hb, ha, "left")
        ok = (left < len(hb)) & (hb[np.minimum(left, len(hb) - 1)] == ha)
        if not ok.any():
            return None
        pairs = []
        for i, at in zip(a[ok].tolist(), left[ok].tolist()):
            h = hb[at]
            while at < len(hb) and hb[at] == h:
                pairs.append((int(b[at]), i))
                at += 1
        return [(i, j) for j, i in sorted(pairs) if np.array_equal(doc[i:i + length], item[j:j + length])]

    top = min(n, m)
    while top >= least:
        # the longest length that still matches: common(L) holds for every shorter length too
        low, high = 0, top
        while low < high:
            mid = (low + high + 1) // 2
            if mid < least:
                mid = least
            if common(mid):
                low = mid
            else:
                high = mid - 1
            if high < least:
                break
        if low < least:
            break
        for i, j in common(low) or []:
            if not marks[0][i:i + low].any() and not marks[1][j:j + low].any():
                out.append((i, j, low))
                marks[0][i:i + low] = True
                marks[1][j:j + low] = True
        top = low
    return out


def _items(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """(item_id, n, tokens, seeds): an item of fewer words than a seed is one seed of its own length."""
    slim = benchmark.filter(F.col(text).isNotNull() & F.col(item).isNotNull()).select(
        F.col(item).cast("long").alias("item_id"), F.col(text).alias("t")).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            word, at = words(b["t"].tolist(), PLAIN)
            rows = []
            for key, i, j in zip(b["item_id"], at[:-1], at[1:]):
                if j > i:
                    own = word[i:j]
                    width = min(SEED, len(own))
                    seeds = np.unique(shingles(own, width)).astype(np.int64)
                    rows.append((key, len(own), width, own.tobytes(), seeds.tolist()))
            yield pd.DataFrame(rows, columns=["item_id", "n", "width", "tokens", "seeds"])
    return slim.mapInPandas(run, "item_id long, n int, width int, tokens binary, seeds array<bigint>")


def contaminated(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, id_col: str = "doc_id",
                 text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, covered, item_words, tiles, longest, coverage) of every pair whose tiles
    cover at least ``cover`` of the item's words.

    Null or empty texts match nothing, as do items without words; items of fewer than ``SEED``
    words must occur whole. Repeated documents or items give repeated pairs once per id. Only
    documents with a seed are shuffled; a document's words stay in one row.
    """
    spark = docs.sparkSession
    items = stash(_items(benchmark, item, item_text), "items")
    mask = F.lit(TABLE_BITS - 1)
    seeds = items.select(F.explode("seeds").alias("seed")).select(F.explode(F.array(
        F.col("seed").bitwiseAND(mask), F.shiftrightunsigned("seed", 24).bitwiseAND(mask))).alias("bit")).select(F.col("bit").cast("int").alias("bit"))
    bits = np.zeros(TABLE_BITS // 8, np.uint8)
    # words of the bit table, or-ed together by Spark: at most TABLE_BITS / 32 rows reach the driver
    packed = (seeds.groupBy((F.col("bit") / 32).cast("int").alias("w"))
              .agg(F.bit_or(F.expr("shiftleft(1L, bit % 32)")).alias("v")).toPandas())
    bits.view("<u4")[packed["w"].to_numpy()] = packed["v"].to_numpy().astype(np.uint32)
    table = spark.sparkContext.broadcast(np.unpackbits(bits, bitorder="little").astype(bool))
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())   # at most SEED values

    mask_bits = np.uint64(TABLE_BITS - 1)

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.iloc[lo:lo + 256]
                word, at = words(part["t"].tolist(), PLAIN)
                rows = {}
                for width in widths:
                    flat = shingles(word, width)
                    own = flat & mask_bits
                    hit = np.flatnonzero(table.value[own])
                    hit = hit[table.value[(flat[hit] >> np.uint64(24)) & mask_bits]]
                    doc = np.searchsorted(at, hit, "right") - 1
                    inside = hit + width <= at[doc + 1]
                    for d, h in zip(doc[inside].tolist(), flat[hit[inside]].astype(np.int64).tolist()):
                        rows.setdefault(d, set()).add(h)
                if rows:
                    keys = part["id"].tolist()
                    yield pd.DataFrame([(keys[d], word[at[d]:at[d + 1]].tobytes(), sorted(s))
                                        for d, s in rows.items()], columns=["doc_id", "tokens", "seeds"])

    found = (docs.filter(F.col(id_col).isNotNull() & F.col(text).isNotNull())
             .select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t"))
             .mapInPandas(candidates, "doc_id long, tokens binary, seeds array<bigint>"))
    found = stash(found.withColumn("doc_key", F.xxhash64("doc_id", "tokens")), "seeded")
    by_seed = items.select("item_id", F.explode("seeds").alias("seed"))
    pairs = (found.select("doc_key", F.explode("seeds").alias("seed")).join(by_seed, "seed")
             .select("doc_key", "item_id").distinct())
    work = (pairs.join(found.select("doc_key", "doc_id", "tokens").dropDuplicates(["doc_key"]), "doc_key")
            .join(items.select("item_id", "n", "width", F.col("tokens").alias("item_tokens"))
                  .dropDuplicates(["item_id", "item_tokens"]), "item_id")
            .select("doc_id", "item_id", "n", "width", "tokens", "item_tokens"))

    def tile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                got = tiles(np.frombuffer(r.tokens, np.uint64), np.frombuffer(r.item_tokens, np.uint64), int(r.width))
                covered = sum(x[2] for x in got)
                if covered >= cover * r.n and covered:
                    rows.append((r.doc_id, r.item_id, covered, r.n, len(got), got[0][2], covered / r.n))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "covered", "item_words", "tiles", "longest", "coverage"])

    out = work.mapInPandas(tile, "doc_id long, item_id long, covered int, item_words int, tiles int, longest int, coverage double")
    return out.groupBy("doc_id", "item_id").agg(*[F.max_by(c, F.struct("coverage", "covered", "item_words", "tiles")).alias(c)
                                                  for c in ("covered", "item_words", "tiles", "longest", "coverage")])
