"""Token ids in Re-Pair compressed shards: one table row a shard, readable at random.

Documents are dealt by ranges of their id and sorted, so shards follow the order of ids. A shard
holds whole documents until it has ``SHARD_IDS`` ids. Its ids are compressed by repeatedly
replacing frequent pairs of neighbours by new symbols: each round takes the most frequent pairs,
and where two of them overlap the more frequent one wins. The row stores the symbol sequence,
the rules (two symbols each, always of earlier rounds) and the length each rule expands to, so a
range of ids is decoded from the few symbols that cover it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions
from .tokens import Encoder

SHARD_IDS = 1 << 20
ROUNDS = 8
ROUND_RULES = 1024
MIN_COUNT = 8

SCHEMA = ("part int, shard int, n_ids long, doc_ids array<bigint>, doc_lengths binary, first_rule long, "
          "width int, sequence binary, rules binary, expansion_lengths binary")
_KIND = {2: "<u2", 4: "<u4"}


def compress(ids: np.ndarray, rounds: int = ROUNDS, round_rules: int = ROUND_RULES,
             min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, int]:
    """(sequence, rules as pairs, first rule symbol); symbols below the first rule are ids."""
    first = int(ids.max()) + 1 if len(ids) else 0
    # symbols of 16 bits make pair keys of 32, which sort faster
    kind, bits = (np.uint32, 16) if first + rounds * round_rules <= 1 << 16 else (np.uint64, 32)
    seq = ids.astype(kind)
    rules: list[np.ndarray] = []
    made = 0
    for _ in range(rounds):
        if len(seq) < 2:
            break
        key = np.sort(seq[:-1] << kind(bits) | seq[1:])
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(head, append=len(key))
        often = np.flatnonzero(count >= min_count)
        if not len(often):
            break
        often = often[np.argsort(-count[often], kind="stable")][:round_rules]
        pairs = np.stack([key[head[often]] >> kind(bits), key[head[often]] & kind((1 << bits) - 1)], axis=1).astype(np.int64)
        # rank of a pair by the row of its first symbol and the column of its second; `none` elsewhere
        none = len(pairs)
        (lefts, i), (rights, j) = (np.unique(pairs[:, c], return_inverse=True) for c in (0, 1))
        rank = np.full((len(lefts) + 1, len(rights) + 1), none, np.int32)
        rank[i + 1, j + 1] = np.arange(none)
        row, column = np.zeros((2, first + made), np.int32)
        row[lefts] = np.arange(1, len(lefts) + 1) * (len(rights) + 1)
        column[rights] = np.arange(1, len(rights) + 1)
        at = rank.ravel()[row[seq[:-1]] + column[seq[1:]]]
        # a place wins against its neighbours by rank; runs of one pair alternate
        want = at * 2
        want[1::2] += 1
        keep = at < none
        keep[1:] &= want[1:] < want[:-1]
        keep[:-1] &= want[:-1] < want[1:]
        places = np.flatnonzero(keep)
        used = np.flatnonzero(np.bincount(at[places], minlength=none))
        symbol = np.zeros(none, kind)
        symbol[used] = first + made + np.arange(len(used))
        seq[places] = symbol[at[places]]
        rest = np.ones(len(seq), bool)
        rest[places + 1] = False
        seq = seq[rest]
        rules.append(pairs[used])
        made += len(used)
    return seq.astype(np.int64), np.concatenate(rules) if rules else np.zeros((0, 2), np.int64), first


def expand(seq: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """All ids of a symbol sequence. A short one has its rules replaced by their pairs until none
    is left; for one longer than the rule list every rule is spelled out once and looked up."""
    seq = seq.astype(np.int64)
    if len(seq) > len(rules):
        words: list[list[int]] = []
        for a, b in rules.tolist():
            words.append((words[a - first] if a >= first else [a]) + (words[b - first] if b >= first else [b]))
        size = np.ones(first + len(words), np.int64)
        size[first:] = [len(w) for w in words]
        spelled = np.concatenate([np.arange(first), np.fromiter(chain.from_iterable(words), np.int64)])
        n = size[seq]
        shift = (np.cumsum(size) - size)[seq] - (np.cumsum(n) - n)
        return spelled[np.repeat(shift, n) + np.arange(n.sum())]
    while True:
        big = seq >= first
        if not big.any():
            return seq
        at = np.cumsum(1 + big) - (1 + big)
        out = np.repeat(seq, 1 + big)
        pair = rules[seq[big] - first]
        out[at[big]] = pair[:, 0]
        out[at[big] + 1] = pair[:, 1]
        seq = out


def rule_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Ids each rule expands to; a rule's symbols come before it."""
    out = np.ones(len(rules), np.int64)
    size = {}
    for i, (a, b) in enumerate(rules.tolist()):
        out[i] = size.get(a, 1) + size.get(b, 1)
        size[first + i] = int(out[i])
    return out


@dataclass
class Shard:
    """A decoded row of the table; arrays are views of its binary columns."""
    sequence: np.ndarray
    rules: np.ndarray
    lengths: np.ndarray
    first: int
    doc_lengths: np.ndarray

    @classmethod
    def of(cls, row) -> Shard:
        kind = _KIND[int(row.width)]
        return cls(np.frombuffer(row.sequence, kind), np.frombuffer(row.rules, kind).astype(np.int64).reshape(-1, 2),
                   np.frombuffer(row.expansion_lengths, "<u4"), int(row.first_rule),
                   np.frombuffer(row.doc_lengths, "<u4"))

    def ids(self, start: int = 0, length: int | None = None) -> np.ndarray:
        """Ids ``start`` .. ``start + length`` of the shard, expanding only the symbols that cover them."""
        if length is None and start == 0:
            return expand(self.sequence, self.rules, self.first)
        seq = self.sequence.astype(np.int64)
        size = np.ones(len(seq), np.int64)
        big = seq >= self.first
        size[big] = self.lengths[seq[big] - self.first]
        end = np.cumsum(size)
        stop = int(end[-1]) if length is None and len(end) else start + (length or 0)
        a, b = np.searchsorted(end, start, "right"), np.searchsorted(end, stop, "left") + 1
        if a >= len(seq) or stop <= start:
            return np.zeros(0, np.int64)
        base = int(end[a] - size[a])
        return expand(seq[a:b], self.rules, self.first)[start - base:stop - base]

    def document(self, index: int) -> np.ndarray:
        before = int(self.doc_lengths[:index].sum())
        return self.ids(before, int(self.doc_lengths[index]))


def encode_table(docs: DataFrame, tokenizer_path: str, end_id: int = 2, blanks: str | None = "leading",
                 id_col: str = "doc_id", text: str = "text", shard_ids: int = SHARD_IDS) -> DataFrame:
    """The rows of the file format for all documents, null text as empty, in rising order of id
    (null ids first, equal ids by text). Only the texts are shuffled, once; a task holds one
    shard at a time."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        config = spark.sparkContext.broadcast(f.read())   # one vocabulary file

    def row(part, shard, keys, parts):
        flat = np.frombuffer(b"".join(parts), "<u4")
        seq, rules, first = compress(flat)
        kind = "<u2" if first + len(rules) <= 1 << 16 else "<u4"
        return pd.DataFrame([{
            "part": part, "shard": shard, "n_ids": len(flat), "doc_ids": keys,
            "doc_lengths": np.array([len(p) // 4 for p in parts], "<u4").tobytes(), "first_rule": first,
            "width": int(kind[-1]), "sequence": seq.astype(kind).tobytes(), "rules": rules.astype(kind).tobytes(),
            "expansion_lengths": rule_lengths(rules, first).astype("<u4").tobytes()}])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder.shared(config.value, blanks, end_id)
        part = TaskContext.get().partitionId()
        keys, parts, size, shard = [], [], 0, 0
        for b in batches:
            for key, got in zip(b["id"], encoder.encode(b["t"].tolist())):
                keys.append(None if pd.isna(key) else int(key))
                parts.append(got)
                size += len(got) // 4
                if size >= shard_ids:
                    yield row(part, shard, keys, parts)
                    keys, parts, size, shard = [], [], 0, shard + 1
        if parts:
            yield row(part, shard, keys, parts)

    return (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t"))
            .repartitionByRange(shuffle_partitions(spark), "id").sortWithinPartitions("id", "t")
            .mapInPandas(run, SCHEMA))


def write(docs: DataFrame, path: str, tokenizer_path: str, **options) -> None:
    """Write the compressed table as Parquet files at ``path`` (Spark's committed output)."""
    encode_table(docs, tokenizer_path, **options).write.parquet(path)


def read_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, part, shard, start, n_tokens, ids_crc32) of every document, decoded from the
    table; ``start`` counts the ids of all documents before it in the whole table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                shard = Shard.of(r)
                raw = memoryview(shard.ids().astype("<u4").tobytes())
                n = shard.doc_lengths.astype(np.int64)
                end = np.cumsum(n)
                yield pd.DataFrame({
                    "doc_id": pd.array([None if pd.isna(x) else int(x) for x in r.doc_ids], "Int64"),
                    "part": r.part, "shard": r.shard, "at": end - n, "n_tokens": n,
                    "ids_crc32": [zlib.crc32(raw[4 * (e - k):4 * e]) for e, k in zip(end.tolist(), n.tolist())]})

    docs = shards.mapInPandas(run, "doc_id long, part int, shard int, at long, n_tokens long, ids_crc32 long")
    sizes = shards.select("part", "shard", "n_ids")
    # ids before a shard: of the earlier partitions (one row each), and of its own earlier shards
    by_part = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = by_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")
    starts = sizes.join(before, "part").select("part", "shard", (F.col("before") + own).alias("base"))
    return (docs.join(starts, ["part", "shard"])
            .select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "part", "shard"))
