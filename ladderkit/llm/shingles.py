"""Word and shingle hashes of whole texts, vectorised over batches of documents.

Words are the runs of bytes other than space and 0x09-0x0D of the UTF-8 text, A-Z lower-cased.
A word's hash mixes a polynomial of its bytes; a shingle's hash mixes those of its words.
"""

from __future__ import annotations

import numpy as np

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: LOWER, and ASCII punctuation as blanks.
PLAIN = bytes(32 if chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else b for b in LOWER)
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x100000001B3)
_POWERS = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(64, 1 << (n - 1).bit_length())
        _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE, np.uint64)]), dtype=np.uint64)
    return _POWERS


def words(texts: list[str | None], table: bytes = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts, offsets: text i has words offsets[i]:offsets[i + 1])."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer((b"\n".join(raw) + b"\n").translate(table), np.uint8)
    solid = ~_BLANK[data]
    edge = np.flatnonzero(np.diff(solid, prepend=False))
    starts, ends = edge[0::2], edge[1::2]
    text_end = np.cumsum([len(r) + 1 for r in raw])
    offsets = np.concatenate([[0], np.searchsorted(starts, text_end, "left")]).astype(np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64), offsets
    size = ends - starts
    at = np.flatnonzero(solid)
    first = np.cumsum(size) - size
    place = np.arange(len(at)) - np.repeat(first, size)
    value = (data[at].astype(np.uint64) + np.uint64(1)) * _powers(int(size.max()))[place]
    return mix(np.add.reduceat(value, first) + size.astype(np.uint64)), offsets


def shingles(word: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words."""
    n = len(word) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + word[i:i + n]
    return mix(h + np.uint64(width))


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted; with fewer words the whole sequence is one; none without words."""
    word, offsets = words(texts)
    out = []
    flat = shingles(word, width)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(flat[a:b - width + 1]))
        elif b > a:
            out.append(shingles(word[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
