"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

A partition's documents are taken in groups of about ``GROUP`` windows. Documents longer than a
window are cut into full windows first; the rest of the group is divided into ``k`` near-equal
windows: every piece starts as a partition of its own (one filled window, k - 1 empty), and the
two partitions of largest spread are merged, fullest with emptiest, until one is left. ``k``
starts at the least number that could hold the group and rises while the windows that exceed
the capacity hold more than ``CUT`` of the group; what still sticks out is cut off and fills
the windows with room, where cutting is allowed.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import Encoder

WINDOW = 4096
GROUP = 64
CUT = 0.05


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Indexes of ``sizes`` in ``k`` sets of near-equal sums (largest differencing method)."""
    if not sizes:
        return [[] for _ in range(k)]
    # an entry: (-spread, tie, sums in rising order, their sets), sums less the least of them
    heap = [(-s, i, [0] * (k - 1) + [s], [()] * (k - 1) + [(i, ())]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        merged = sorted(((a[i] + b[k - 1 - i], i) for i in range(k)))
        low = merged[0][0]
        heapq.heappush(heap, (low - merged[-1][0], tie, [s - low for s, _ in merged],
                              [_both(x[i], y[k - 1 - i]) for _, i in merged]))
        tie += 1
    return [_flat(t) for t in heap[0][3]]


def _both(a, b):
    """Sets are kept as trees: () empty, (index, ()) one, (None, (left, right)) a union."""
    return b if not a else a if not b else (None, (a, b))


def _flat(t) -> list[int]:
    out, todo = [], [t]
    while todo:
        t = todo.pop()
        if t and t[0] is None:
            todo.extend(t[1])
        elif t:
            out.append(t[0])
    return sorted(out)


def windows(pieces: list[tuple[int, int, int]], capacity: int, cut: bool = True) -> list[list[tuple[int, int, int]]]:
    """Windows of (document, start, length) pieces, each sum at most ``capacity``.

    Without ``cut`` pieces stay whole (none may exceed the capacity) and the window count rises
    until differencing fits; with it, only until the overhang is small.
    """
    sizes = [p[2] for p in pieces]
    total = sum(sizes)
    k = max(1, -(-total // capacity))
    while True:
        sets = difference(sizes, k)
        loads = [sum(sizes[i] for i in s) for s in sets]
        over = sum(max(0, x - capacity) for x in loads)
        if over == 0 or (cut and over <= CUT * total):
            break
        k += 1
    out = [[pieces[i] for i in s] for s in sets]
    if over:
        loose = []
        for w, load in zip(out, loads):
            while load > capacity:
                doc, start, size = w.pop()
                off = min(size, load - capacity)
                if size > off:
                    w.append((doc, start, size - off))
                loose.append((doc, start + size - off, off))
                load -= off
        room = [(capacity - sum(p[2] for p in w), w) for w in out]
        for doc, start, size in loose:
            while size:
                free, w = room[-1]
                if not free:
                    room.pop()
                    continue
                part = min(size, free)
                w.append((doc, start, part))
                room[-1] = (free - part, w)
                start, size = start + part, size - part
    return [w for w in out if w]


def _groups(lengths: Iterator[tuple[int, int]], capacity: int, group: int):
    """Pieces by group: a group is cut at exactly ``group`` windows, the rest opens the next one."""
    pieces, total = [], 0
    for doc, size in lengths:
        start = 0
        while size:
            part = min(size, group * capacity - total)
            pieces.append((doc, start, part))
            start, size, total = start + part, size - part, total + part
            if total == group * capacity:
                yield pieces
                pieces, total = [], 0
    if pieces:
        yield pieces


def _sequences(pieces, capacity: int, cut: bool):
    """Full windows of long pieces, then the packed rest."""
    short = []
    for doc, start, size in pieces:
        while cut and size >= capacity:
            yield [(doc, start, capacity)]
            start, size = start + capacity, size - capacity
        if size:
            short.append((doc, start, size))
    if short:
        yield from windows(short, capacity, cut)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = WINDOW, end_id: int = 2, blanks: str | None = "dropped",
         id_col: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).

    Each document is its whole text's ids and the end id, so an empty or null text is one id;
    every id lies in exactly one piece, a window holds at most ``capacity`` ids and its pieces
    lie without gaps. Each partition packs on its own, in order, without a shuffle; at most one
    window a partition is left partly empty. Repeated rows are packed each. With ``ids`` the
    pieces' ids are returned as binary (little-endian unsigned 32-bit).
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        config = docs.sparkSession.sparkContext.broadcast(f.read())   # one vocabulary file
    schema = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
              + ", ids binary" * ids)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder.shared(config.value, blanks, end_id)
        held: dict[int, tuple] = {}
        seen = 0
        seq = TaskContext.get().partitionId() << 40

        def lengths():
            nonlocal seen
            for b in batches:
                for key, got in zip(b["id"], encoder.encode(b["t"].tolist())):
                    held[seen] = (key, got)
                    yield seen, len(got) // 4
                    seen += 1

        for pieces in _groups(lengths(), capacity, GROUP):
            rows = []
            for w in _sequences(pieces, capacity, True):
                offset = 0
                for doc, start, size in w:
                    key, got = held[doc]
                    part = got[4 * start:4 * (start + size)]
                    rows.append((key, start, size, zlib.crc32(part), len(got) // 4, seq, offset) + (part,) * ids)
                    offset += size
                seq += 1
            last = max(p[0] for p in pieces)
            for doc in [d for d in held if d < last]:
                del held[doc]
            out = pd.DataFrame(rows, columns=names)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t")).mapInPandas(run, schema)
