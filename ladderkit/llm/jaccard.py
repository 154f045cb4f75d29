"""Exact Jaccard join of documents on their n-gram sets, by prefix trees.

1. Every text becomes its set of 5-word shingles (64-bit hashes). Blocks of documents send each
   shingle once to the shuffle, as 32 bits in a range of hashes; a shingle met in two blocks, or
   twice in one, is shared. A document of which under 75 % is shared links with nothing.
2. What is left is collapsed by equal sets. Shingles are counted over the remaining sets and
   ordered by rarity; two linked sets share one in the prefixes that the threshold leaves.
3. Sets that meet are joined in prefix trees: sets, ordered by frequency in the block, are stored
   in a trie; a probe walks it with the overlap so far, which all sets below a node share, and
   leaves a subtree when its sizes or what remains of either side cannot reach the threshold, or
   when it is linked with the probe already. First each set is joined with those that share its
   leader (the least set of its prefix shingles), in blocks of bounded size; then every remaining
   pair that meets in a prefix and lies in different components is probed.

The result is whole: every link either is found or lies inside one component. Groups of copies
cost one link a member, not one a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, shuffle_partitions, stash
from .shingles import mix, shingle_sets

NUM, DEN = 75, 100
BLOCK_DOCS = 4096        # documents of one block of the first step
BLOCK_SHINGLES = 1_000_000
TREE_SETS = 512          # sets of one prefix tree
BROADCAST_IDS = 1_000_000
_SHARED = 65_535


def required(nx, ny):
    """Least intersection of linked sets of these sizes (numbers or arrays)."""
    return -(-NUM * (nx + ny) // (NUM + DEN))


# ---- step 1: shared shingles -------------------------------------------------------------

def _blocks(batches: Iterator[pd.DataFrame]):
    """Sets of consecutive documents, at most BLOCK_DOCS and about BLOCK_SHINGLES at a time."""
    ids, sets, size = [], [], 0
    for b in batches:
        for i in range(0, len(b), 256):
            part = b.iloc[i:i + 256]
            for key, s in zip(part["id"].tolist(), shingle_sets(part["t"].tolist())):
                ids.append(key)
                sets.append(s)
                size += len(s)
                if len(ids) == BLOCK_DOCS or size >= BLOCK_SHINGLES:
                    yield ids, sets
                    ids, sets, size = [], [], 0
    if ids:
        yield ids, sets


def _signature(s: np.ndarray) -> tuple[int, int]:
    a = mix(s + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64)
    b = np.bitwise_xor.reduce(mix(s ^ np.uint64(0xD6E8FEB86659FD93)), initial=np.uint64(0))
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _send(ranges: int):
    """Rows: key >= 0, a range of hashes: the block's shingles there (32 bits, document in the
    block); key < 0: the block itself (ids, sizes, shingles shared inside the block, signatures)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = TaskContext.get().partitionId() << 32
        for ids, sets in _blocks(batches):
            sizes = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate(sets)
            doc = np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(flat)
            flat, doc = flat[order], doc[order]
            first = np.ones(len(flat), bool)
            first[1:] = flat[1:] != flat[:-1]
            run_id = np.cumsum(first) - 1
            many = np.bincount(run_id)[run_id] > 1 if len(flat) else np.zeros(0, bool)
            inside = np.bincount(doc[many], minlength=len(sets))
            doc = np.where(many, _SHARED, doc).astype(np.uint16)[first]
            flat = flat[first]
            key = ((flat >> np.uint64(40)) * np.uint64(ranges)) >> np.uint64(24)
            at = np.searchsorted(key, np.arange(ranges + 1, dtype=np.uint64))
            low = flat.astype(np.uint32)
            sig = np.array([_signature(s) for s in sets], np.int64)
            rows = [(-1 - block, block, np.array(ids, np.int64).tobytes(), sizes.tobytes(),
                     inside.astype(np.int64).tobytes(), sig.tobytes())]
            rows += [(k, block, low[i:j].tobytes(), doc[i:j].tobytes(), b"", b"")
                     for k, (i, j) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())) if j > i]
            yield pd.DataFrame(rows, columns=["key", "block", "a", "b", "c", "d"])
            block += 1
    return run


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """For a range of hashes: how many of each block's documents' shingles another block has too."""
    if pdf["key"].iat[0] < 0:
        return pdf[["block", "key", "a", "b", "c", "d"]]
    low = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["a"]])
    doc = np.concatenate([np.frombuffer(x, np.uint16) for x in pdf["b"]])
    row = np.repeat(np.arange(len(pdf)), [len(x) // 4 for x in pdf["a"]])
    order = np.argsort(low, kind="stable")
    same = low[order][1:] == low[order][:-1]
    shared = np.zeros(len(low), bool)
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    shared &= doc != _SHARED
    cells, count = np.unique(row[shared] * BLOCK_DOCS + doc[shared], return_counts=True)
    rows, at = np.unique(cells // BLOCK_DOCS, return_index=True)
    cut = np.append(at, len(cells))
    return pd.DataFrame([(pdf["block"].iat[i], 0, (cells[a:b] % BLOCK_DOCS).astype(np.uint16).tobytes(),
                          count[a:b].astype(np.uint32).tobytes(), b"", b"")
                         for i, a, b in zip(rows, cut[:-1], cut[1:])],
                        columns=["block", "key", "a", "b", "c", "d"])


def _gather(pdf: pd.DataFrame) -> pd.DataFrame:
    own = pdf["key"] < 0
    r = pdf[own].iloc[0]
    ids = np.frombuffer(r["a"], np.int64)
    size = np.frombuffer(r["b"], np.int64)
    shared = np.frombuffer(r["c"], np.int64).copy()
    sig = np.frombuffer(r["d"], np.int64).reshape(-1, 2)
    for doc, count in zip(pdf.loc[~own, "a"], pdf.loc[~own, "b"]):
        shared[np.frombuffer(doc, np.uint16)] += np.frombuffer(count, np.uint32)
    return pd.DataFrame({"id": ids, "n": size, "shared": shared, "s1": sig[:, 0], "s2": sig[:, 1]})


def profile(docs: DataFrame) -> DataFrame:
    """(id, n, shared, s1, s2) of every row of (id, t): set size, an upper bound of the shingles
    that any other row has, and a 128-bit signature of the set."""
    ranges = shuffle_partitions(docs.sparkSession)
    sent = docs.mapInPandas(_send(ranges), "key long, block long, a binary, b binary, c binary, d binary")
    met = sent.groupBy("key").applyInPandas(_meet, "block long, key long, a binary, b binary, c binary, d binary")
    return met.groupBy("block").applyInPandas(_gather, "id long, n long, shared long, s1 long, s2 long")


# ---- step 3: prefix trees ----------------------------------------------------------------

class _Node:
    __slots__ = ("seg", "kids", "docs", "least", "most", "rest", "link")

    def __init__(self, seg):
        self.seg, self.kids, self.docs = seg, {}, []
        self.least, self.most, self.rest, self.link = 1 << 62, 0, 0, None


class PrefixTree:
    """Sets of ranks in rising order, with their full sizes; links by union-find over their indexes."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int]):
        self.sets, self.sizes = sets, sizes
        self.root = _Node(np.zeros(0, np.int64))
        self.up = list(range(len(sets)))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def insert(self, i: int) -> None:
        s, n, node, at = self.sets[i], self.sizes[i], self.root, 0
        while True:
            node.least, node.most = min(node.least, n), max(node.most, n)
            node.rest = max(node.rest, len(s) - at)
            # the one component of all sets below, or -1 once they are of several
            node.link = i if node.link is None else node.link if node.link >= 0 and self.find(node.link) == self.find(i) else -1
            if at == len(s):
                node.docs.append(i)
                return
            kid = node.kids.get(int(s[at]))
            if kid is None:
                kid = _Node(s[at:])
                node.kids[int(s[at])] = kid
                node, at = kid, len(s)
                continue
            k = min(len(kid.seg), len(s) - at)
            differ = np.flatnonzero(kid.seg[:k] != s[at:at + k])
            same = int(differ[0]) if len(differ) else k
            if same < len(kid.seg):     # split the segment
                top = _Node(kid.seg[:same])
                top.least, top.most, top.link = kid.least, kid.most, kid.link
                top.rest = kid.rest + len(kid.seg) - same
                node.kids[int(s[at])] = top
                kid.seg = kid.seg[same:]
                top.kids[int(kid.seg[0])] = kid
                kid = top
            node, at = kid, at + same

    def probe(self, i: int, skip_linked: bool = True) -> list[int]:
        """Indexes of inserted sets that link with set ``i``; with ``skip_linked`` at most one a component."""
        s, n = self.sets[i], self.sizes[i]
        out, todo = [], [(self.root, 0)]
        while todo:
            node, got = todo.pop()
            if node.least == 1 << 62 or DEN * n < NUM * node.least or DEN * node.most < NUM * n:
                continue
            if skip_linked and node.link is not None and node.link >= 0 and self.find(node.link) == self.find(i):
                continue
            rest = len(s)
            if len(node.seg):
                at = np.searchsorted(s, node.seg)
                got += int((s[np.minimum(at, len(s) - 1)] == node.seg).sum()) if len(s) else 0
                rest = len(s) - int(np.searchsorted(s, node.seg[-1], "right"))
            if got + min(rest, node.rest) < required(n, max(node.least, -(-NUM * n // DEN))):
                continue
            for d in node.docs:
                if DEN * got >= NUM * (n + self.sizes[d] - got) and got:
                    if skip_linked:
                        a, b = self.find(i), self.find(d)
                        if a == b:
                            continue
                        self.up[max(a, b)] = min(a, b)
                    out.append(d)
            # the children that match the probe come last on the stack, so first in turn
            for match in (False, True):
                todo.extend((kid, got) for first, kid in node.kids.items() if _has(s, first) == match)
        return out


def _has(s: np.ndarray, x: int) -> bool:
    at = int(np.searchsorted(s, x))
    return at < len(s) and int(s[at]) == x


def _ranks(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Shingles as ranks by falling frequency among ``sets``; those of one set only are left out."""
    flat = np.concatenate(sets)
    values, where, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(values))
    shared = count[where] > 1
    cut = np.cumsum([0] + [len(s) for s in sets])
    flat = rank[where]
    return [np.sort(flat[i:j][shared[i:j]]) for i, j in zip(cut[:-1], cut[1:])]


def _join_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links that span the components of a block's sets, which all meet in one tree."""
    pdf = pdf.drop_duplicates("id").sort_values(["n", "id"])
    ids = pdf["id"].tolist()
    tree = PrefixTree(_ranks([np.frombuffer(x, np.int64) for x in pdf["tokens"]]), pdf["n"].tolist())
    rows = []
    for i in range(len(ids)):
        rows += [(ids[i], ids[j]) for j in tree.probe(i)]
        tree.insert(i)
    return pd.DataFrame(rows, columns=["a", "b"])


def _probe_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of the probe (the row whose id is the key) with the other sets of the block."""
    own = pdf["id"] == pdf["g"]
    if not own.any() or own.all():
        return pd.DataFrame(columns=["a", "b"])
    pdf = pd.concat([pdf[own].iloc[:1], pdf[~own].drop_duplicates("id").sort_values(["n", "id"])])
    ids = pdf["id"].tolist()
    tree = PrefixTree(_ranks([np.frombuffer(x, np.int64) for x in pdf["tokens"]]), pdf["n"].tolist())
    for i in range(1, len(ids)):
        tree.insert(i)
    return pd.DataFrame([(ids[0], ids[j]) for j in tree.probe(0, skip_linked=False)], columns=["a", "b"])


def _in_blocks(members: DataFrame, sets: DataFrame, join) -> DataFrame:
    """``members`` (g, id): the sets of each g, which is one of them, dealt over blocks of about
    TREE_SETS by a hash of the id; g's own set goes to every block."""
    sizes = members.groupBy("g").agg(F.ceil(F.count("*") / TREE_SETS).cast("int").alias("blocks"))
    rest = members.filter("id <> g").join(sizes, "g").select(
        "g", "id", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("salt"))
    heads = sizes.select("g", F.col("g").alias("id"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt"))
    return (rest.unionByName(heads).join(sets.select("id", "n", "tokens"), "id")
            .groupBy("g", "salt").applyInPandas(join, "a long, b long"))


# ---- the join ----------------------------------------------------------------------------

def _shared_prefixes(sets: DataFrame) -> DataFrame:
    """(id, n, tokens, probe, own): a set's shingles that another set has, and its prefixes of
    (shingle, place) in the order of rarity. ``own`` is the shorter prefix that suffices
    against sets of the same size or larger ones."""
    tok = sets.select("id", "n", F.explode("shingles").alias("t"))
    often = tok.groupBy("t").agg(F.count("*").alias("c")).filter("c > 1")
    got = (tok.join(often, "t").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("c", "t"))).alias("s"))
           .withColumn("m", F.size("s")).filter(f"{DEN} * m >= {NUM} * n"))
    single = F.col("n") - F.col("m")

    def prefix(least: str) -> Column:
        length = F.expr(f"cast(n - {least} + 1 as int)") - single.cast("int")
        return F.transform(F.slice("s", 1, F.greatest(length, F.lit(0))),
                           lambda x, i: F.struct(x["t"].alias("t"), (single + i).cast("int").alias("place")))

    return got.select("id", "n", F.col("s.t").alias("tokens"),
                      prefix(f"(({NUM} * n + {DEN - 1}) div {DEN})").alias("probe"),
                      prefix(f"((2 * {NUM} * n + {NUM + DEN - 1}) div {NUM + DEN})").alias("own"))


def _to_binary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        b["tokens"] = [np.sort(np.asarray(x, np.int64)).tobytes() for x in b["tokens"]]
        yield b


def _leaders(post: DataFrame) -> DataFrame:
    """(g, id): each set with the leader that most of its prefix shingles have, ties to the least;
    a shingle's leader is its least set."""
    lead = post.groupBy("t").agg(F.min("id").alias("g"))
    votes = post.select("t", "id").join(lead, "t").groupBy("id", "g").agg(F.count("*").alias("v"))
    best = votes.groupBy("id").agg(F.max(F.struct("v", (-F.col("g")).alias("g"))).alias("x"))
    best = best.select("id", (-F.col("x.g")).alias("g"))
    return best.unionByName(best.select(F.col("g").alias("id"), "g")).distinct()


def linked_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row with an id.

    Null, empty and blank texts have no shingles and are components of their own; texts of fewer
    than five words are one shingle. Equal sets are linked. Rows without an id are left out;
    repeated ids are one node of the graph, with a row each.
    """
    docs = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t"))
    all_docs = stash(profile(docs), "shingles")
    near = all_docs.filter(f"n > 0 and {DEN} * shared >= {NUM} * n")
    groups = stash(near.groupBy("s1", "s2", "n").agg(F.min("id").alias("rep")), "sets")
    copies = (near.join(groups, ["s1", "s2", "n"]).filter("id <> rep")
              .select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct())
    copies = stash(copies, "copies")
    reps = groups.select(F.col("rep").alias("id"), "s1", "s2", "n")
    keys = reps.select("id").distinct()
    if groups.count() <= BROADCAST_IDS:
        keys = F.broadcast(keys)
    # the sets of the representatives are made again from their texts instead of kept for all

    def sets_again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 256):
                part = b.iloc[i:i + 256]
                sets = shingle_sets(part["t"].tolist())
                sig = [_signature(s) for s in sets]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "n": [len(s) for s in sets],
                                    "s1": [x[0] for x in sig], "s2": [x[1] for x in sig],
                                    "shingles": [s.astype(np.int64) for s in sets]})

    made = docs.join(keys, "id", "left_semi").mapInPandas(
        sets_again, "id long, n long, s1 long, s2 long, shingles array<bigint>")
    # one set an id here: ids that repeat with several texts keep one node a set, numbered below
    sets = made.join(reps, ["id", "s1", "s2", "n"], "left_semi").dropDuplicates(["s1", "s2", "n"])
    node = F.struct("id", "s1", "s2", "n")
    repeated = reps.groupBy("id").agg(F.count("*").alias("k")).filter("k > 1").limit(1).count() > 0
    if repeated:
        sets = sets.withColumn("node", F.xxhash64(node))
    else:
        sets = sets.withColumn("node", F.col("id"))
    names = sets.select("node", "id")
    pref = _shared_prefixes(sets.select(F.col("node").alias("id"), "n", "shingles"))
    pref = stash(pref.mapInPandas(_to_binary, "id long, n long, tokens binary, probe array<struct<t:bigint,place:int>>, "
                                              "own array<struct<t:bigint,place:int>>"), "prefixes")
    probe = pref.select("id", "n", F.explode("probe").alias("x")).select("id", "n", "x.t", "x.place")
    own = pref.select("id", "n", F.explode("own").alias("x")).select("id", "n", "x.t", "x.place")
    first = stash(_in_blocks(_leaders(probe), pref, _join_block), "links")
    comp = components(first).withColumnRenamed("root", "comp")
    label = lambda d: (d.join(comp, d["id"] == comp["node"], "left")
                       .select("id", "n", "t", "place", F.coalesce("comp", "id").alias("comp")))
    lp, lo = label(probe), label(own)
    mixed = lp.groupBy("t").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("t")
    lp = lp.join(mixed, "t", "left_semi").alias("p")
    lo = lo.join(mixed, "t", "left_semi").alias("o")
    meet = lp.join(lo, (F.col("p.t") == F.col("o.t")) & (F.col("p.comp") != F.col("o.comp"))
                   & F.expr("o.n < p.n or (o.n = p.n and o.id < p.id)")
                   & F.expr(f"{DEN} * o.n >= {NUM} * p.n")
                   & F.expr(f"{NUM + DEN} * (1 + least(o.n - o.place - 1, p.n - p.place - 1)) >= {NUM} * (o.n + p.n)"))
    pairs = meet.select(F.col("p.id").alias("g"), F.col("o.id").alias("id")).distinct()
    pairs = stash(pairs, "pairs")
    pairs = pairs.unionByName(pairs.select("g", F.col("g").alias("id")).distinct())
    second = _in_blocks(pairs, pref, _probe_block)
    links = first.unionByName(second)
    if repeated:
        links = (links.join(names.select(F.col("node").alias("a"), F.col("id").alias("ia")), "a")
                 .join(names.select(F.col("node").alias("b"), F.col("id").alias("ib")), "b")
                 .select(F.col("ia").alias("a"), F.col("ib").alias("b")))
    roots = components(links.unionByName(copies))
    return (all_docs.join(roots, all_docs["id"] == roots["node"], "left")
            .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                    F.coalesce("root", "id").alias("component_id")))
