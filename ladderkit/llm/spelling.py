"""Spelling variants by a variable-length gram index (edit distance one).

Words are letter runs of whole texts, counted over all documents. The gram dictionary holds the
grams of two letters and, below every gram that stands more often than a threshold in the words,
its extensions, up to ``Q_MAX`` letters: frequent grams get longer, rare ones stay short. A word
(between a start and an end mark) is decomposed into one positional gram a position, the longest
on the dictionary's path there. What a gram is depends on its own letters alone, so one edit
affects just the grams that hold its place: of any grams of a word, at most the largest number
that share a place. Two grams without a common place have the bound one, so an edit leaves one of
the two, and merging their two lists finds every word at distance one. Each word merges the pair
whose lists are shortest; what it meets at the right length and position passes a letter signature
and is verified. Lists longer than ``BLOCK`` words are cut into blocks, each joined on its own.

Nulls and blank texts have no words; a null id counts as an empty one in the hash; repeated rows
count again; without words the result is empty. Only the dictionary's inner grams are broadcast:
each stands in more than 1/``DICTIONARY`` of the positions, so there are at most
``DICTIONARY`` * (``Q_MAX`` - 1) of them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

MIN_LENGTH = 6      # code points of a word
MIN_COUNT = 5       # occurrences of a word
RATIO = 5           # a form has at least so many times the word's occurrences
TYPO_EVERY = 199    # runs whose hash this divides lose a letter
Q_MAX = 6           # letters of the longest gram; at most MIN_LENGTH, so two grams without a common place exist
DICTIONARY = 1 << 15
RARE = 100          # a gram in no more words is not extended
BLOCK = 4096        # words of a list joined at once

_RUN = re.compile("[a-zÀ-ÿ]+")


def _grams(word: str, inner: dict[str, int]) -> list[tuple[int, str]]:
    """Positional grams of a marked word: at each place the shortest gram that is not an inner one."""
    n, out = len(word), []
    for p in range(n - 1):
        e = p + 2
        while e < n and e - p < Q_MAX and word[p:e] in inner:
            e += 1
        out.append((p, word[p:e]))
    return out


def _cheapest_pair(grams: list[tuple[int, str]], inner: dict[str, int]) -> tuple:
    """The two grams without a common place whose lists are shortest (an inner gram's count is
    known, any other's is below the threshold; the longer one is taken to be rarer)."""
    cost = [(inner.get(g, 0), -len(g), p) for p, g in grams]
    right = list(range(len(grams)))     # the best gram that starts at a place or later
    for i in range(len(grams) - 2, -1, -1):
        right[i] = min(i, right[i + 1], key=cost.__getitem__)
    best = None
    for i, (p, g) in enumerate(grams):
        if p + len(g) < len(grams):
            j = right[p + len(g)]
            both = (cost[i][0] + cost[j][0], cost[i][1] + cost[j][1])
            if best is None or both < best[0]:
                best = (both, grams[i], grams[j])
    return best[1:]


def count_words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
                typo_every: int | None = TYPO_EVERY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(word, n): letter runs of all documents, A to Z in lower case, at least ``min_length`` code
    points and ``min_count`` occurrences. Where ``typo_every`` divides the crc32 of
    ``<key>:<run>``, the run loses its letter number crc32 modulo length first."""
    slim = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for k, t in zip(b.column(0).to_pylist(), b.column(1)):
                raw = t.as_py()
                if not raw:
                    continue
                head = zlib.crc32(f"{k}:".encode())
                found = Counter(_RUN.findall(raw.encode("utf-8", "replace").lower().decode()))
                for w, n in found.items():
                    if len(w) < min_length:
                        continue
                    if typo_every:
                        h = zlib.crc32(w.encode(), head)
                        if h % typo_every == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1:]
                            if len(w) < min_length:
                                continue
                    seen[w] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
                                             names=["word", "n"])
    return (slim.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= min_count))


def dictionary(words: DataFrame) -> dict[str, int]:
    """Inner grams and the words' positions that hold them: those to be extended."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for w in b.column(0).to_pylist():
                w = f"^{w}$"
                for q in range(2, Q_MAX + 1):
                    seen.update(w[p:p + q] for p in range(len(w) - q + 1))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
                                             names=["gram", "n"])
    positions = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    least = max(RARE, positions // DICTIONARY)
    rows = (words.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
            .filter(F.col("n") > least).collect())
    return {r["gram"]: r["n"] for r in rows}


def _signature(word: str) -> int:
    """64 bits, one for each residue of the code points that occur; one edit changes at most two."""
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) % 64)
    return bits - (1 << 64) if bits >> 63 else bits


_ROW = "gram string, len int, pos int, word string, n long, sig long"


def _listed(words: DataFrame, inner, probe: bool) -> DataFrame:
    """Rows of the gram lists, or with ``probe`` the two lists a word merges, at the lengths and
    positions at which a word of its length or one more letter can stand in them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = inner.value
        for b in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                marked, sig = f"^{w}$", _signature(w)
                grams = _grams(marked, known)
                if probe:
                    at = [(g, len(w) + d, p + s) for p, g in _cheapest_pair(grams, known) for d, s in ((0, 0), (1, 0), (1, 1))]
                else:
                    at = [(g, len(w), p) for p, g in grams]
                for c, values in zip(cols, (*zip(*at), [w] * len(at), [n] * len(at), [sig] * len(at))):
                    c.extend(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))],
                names=["gram", "len", "pos", "word", "n", "sig"])
    return (words.mapInArrow(run, _ROW)
            .select(F.xxhash64("gram", "len", "pos").alias("key"), "len", "word", "n", "sig"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n), both ways, for all pairs of words at edit distance one."""
    spark = words.sparkSession
    words = words.select("word", "n")
    inner = spark.sparkContext.broadcast(dictionary(words))
    lists = _listed(words, inner, probe=False)
    probes = _listed(words, inner, probe=True)
    hot = (lists.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > BLOCK)
           .select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    blocks = F.coalesce("blocks", F.lit(1))
    lists = (lists.join(hot, "key", "left")
             .select("key", F.pmod(F.xxhash64("word"), blocks).cast("int").alias("block"),
                     F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("sig").alias("b_sig")))
    probes = (probes.join(hot, "key", "left")
              .select("key", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"),
                      F.col("len").alias("len"), F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("sig").alias("a_sig")))
    met = (probes.join(lists, ["key", "block"])
           .filter((F.bit_count(F.col("a_sig").bitwiseXOR(F.col("b_sig"))) <= 2)
                   & ((F.col("len") > F.length("a")) | (F.col("a") < F.col("b")))
                   & (F.levenshtein("a", "b", 1) == 1))
           .select("a", "a_n", "b", "b_n").distinct())
    met = stash(met, "near")
    return (met.select(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n"))
            .unionByName(met.select(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form) rows: forms followed to the last, doubling the step each round."""
    cur = stash(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = cur.select(F.col("word").alias("root"), F.col("root").alias("further"))
        nxt = stash(cur.join(step, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if not nxt.filter("moved").head(1):
            return nxt.select("word", "root")
        cur = nxt.select("word", "root")


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of ``words`` (word, n; distinct words of
    at least ``MIN_LENGTH`` code points). A word's form is the near word of largest n, ties to the
    smallest, where that n is at least ``ratio`` times the word's."""
    words = stash(words.select("word", "n"), "words")
    near = (near_pairs(words).groupBy("word")
            .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("neg"), "near")).alias("top"),
                 F.first("n").alias("n")))
    is_form = -F.col("top.neg") >= ratio * F.col("n")
    near = stash(near.select("word", "n_near", F.when(is_form, F.col("top.near")).alias("form"),
                             F.when(is_form, -F.col("top.neg")).alias("form_n")), "near")
    last = roots(near.filter("form IS NOT NULL"))
    return (words.join(near, "word", "left").join(last, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"))
