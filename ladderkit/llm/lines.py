"""Line dedup by an exact set-similarity join on line tokens, in DataFrame operations only.

A line is the set of its lower-cased words. Words are ordered by rarity: occurrences are counted
in a table of ``BUCKETS`` hash buckets (fixed size), whose ranks order the words; a word is kept
as its bucket's rank and the rest of its hash, so sorting a line's numbers puts rare words first.
Lines of equal sets are collapsed to their first place. Two lines match at a Jaccard similarity
of ``NUM / DEN``; then they share a word in the prefixes that the threshold leaves, the smaller
in its shorter one. Pairs that meet pass the length and positional filters and the parity
filter (128 parities of the words' hashes, or 256 for long lines, cannot differ in more places
than the sets; with 64, lines of over 80 words pass that have nothing else in common, with 128
those of over 150) and are verified on the whole sets. A line goes when any line at an earlier
place matches it, whether that one stays or not; places are in the order of doc_id, line number
and the line's hash.

Groups of similar lines do not pair up: each line is tried first against the earliest line of
each of its prefix words, and afterwards only pairs whose later line is still open are looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import pii
from .common import BROADCAST_ROWS, small, stash

NUM, DEN = 75, 100
BITS = 16                  # so few that counting them stays in a task's fast map
BUCKETS = 1 << BITS
WIDE = 128                 # words from which 128 parities are too full to tell sets apart, and a set has 256
SIGNATURE = ["parity", "odd", "half", "both"]
SLICES = 3                 # parts of the words whose postings are joined one after the other, to hold less disk


def _words(text: Column) -> Column:
    text = F.lower(text)
    for blank in ("\t", "\r"):
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(text, " ", -1), "")


def _worded(line: Column) -> Column:
    return line.rlike("[^ \t\r]")


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _ranks(docs: DataFrame) -> DataFrame:
    """One row, ``ranks``: for each bucket its place when buckets are ordered by their count, in
    the upper bits, where the number of a word has it."""
    counts = (docs.select(F.explode(_words(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")))).alias("w"))
              .select(_bucket(F.xxhash64("w")).cast("long").alias("id")).groupBy("id").agg(F.count("*").alias("c")))
    full = (docs.sparkSession.range(BUCKETS).join(counts, "id", "left")
            .select("id", F.expr("row_number() over (order by coalesce(c, 0), id) - 1").cast("long").alias("rank")))
    packed = F.sort_array(F.collect_list(F.col("id") * BUCKETS + F.col("rank")))
    return full.agg(F.transform(packed, lambda x: F.shiftleft(F.pmod(x, F.lit(BUCKETS)), 63 - BITS)).alias("ranks"))


def _split(docs: DataFrame) -> DataFrame:
    """(doc, line, t, hash) of every line with a word."""
    return (docs.select("doc", F.posexplode(F.split("text", "\n", -1)).alias("line", "t"))
            .filter(_worded(F.col("t"))).select("doc", "line", "t", F.xxhash64("t").alias("hash")))


def _sets(split: DataFrame, ranks: DataFrame) -> DataFrame:
    """(doc, line, hash, s1, n, words) of split lines: words as numbers in the order of rarity."""

    def number(h: Column) -> Column:
        # 16 bits of rank (one a bucket, so 16 bits of the hash) and the upper 47 bits of the hash
        return F.coalesce(F.get("ranks", _bucket(h)).bitwiseOR(F.shiftrightunsigned(h, BITS + 1)), F.lit(0).cast("long"))

    hashes = F.array_distinct(F.transform(_words(F.col("t")), lambda w: F.xxhash64(w)))
    words = F.sort_array(F.transform(hashes, number))
    return (split.withColumn("ranks", ranks.scalar()).select("doc", "line", "hash", words.alias("words"))
            .select("doc", "line", "hash", F.xxhash64("words").alias("s1"), F.size("words").alias("n"), "words"))


def _parities(bit: Callable[[Column], Column]) -> Column:
    """64 parities of the words, each at the place of its lowest six bits, of the words whose ``bit`` is 1."""
    return F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a.bitwiseXOR(
        F.call_function("shiftleft", bit(w).cast("long"), w.bitwiseAND(F.lit(63)).cast("int"))))


def _signature() -> list[Column]:
    """256 parities of the words by the lowest eight bits: all words, those of bit 6, of bit 7 and of both.
    The latter two, left 0 in sets of under ``WIDE`` words, split the first two further."""
    six, seven = (lambda w: F.getbit(w, F.lit(6))), (lambda w: F.getbit(w, F.lit(7)))
    wide = lambda bit: F.when(F.size("words") >= WIDE, _parities(bit)).otherwise(F.lit(0).cast("long"))
    return [_parities(lambda w: F.lit(1)).alias("parity"), _parities(six).alias("odd"),
            wide(seven).alias("half"), wide(lambda w: six(w).bitwiseAND(seven(w))).alias("both")]


def _need(n: str, other: str | None = None) -> str:
    """SQL for the least overlap: of a set of ``n`` with any match, or with one of ``other`` words."""
    if other is None:
        return f"(({NUM} * {n} + {DEN - 1}) div {DEN})"
    return f"(({NUM} * ({n} + {other}) + {NUM + DEN - 1}) div {NUM + DEN})"


def _passes(a: str, b: str, inner: str = "") -> Column:
    """Length, positional and parity filters of two posting rows, whose parities are in ``inner``."""
    na, nb, need = f"{a}.n", f"{b}.n", _need(f"{a}.n", f"{b}.n")
    p, o, h, x = (f"({a}{inner}.{c} ^ {b}{inner}.{c})" for c in SIGNATURE)
    most = f"{na} + {nb} - 2 * {need}"
    return (F.expr(f"{DEN} * least({na}, {nb}) >= {NUM} * greatest({na}, {nb})")
            & F.expr(f"1 + least({na} - {a}.place - 1, {nb} - {b}.place - 1) >= {need}")
            & F.expr(f"bit_count({p}) <= {most}")
            & F.expr(f"bit_count({p} ^ {o}) + bit_count({o}) <= {most}")
            & F.expr(f"least({na}, {nb}) < {WIDE} or bit_count({p} ^ {o} ^ {h} ^ {x}) + bit_count({o} ^ {x}) + bit_count({h} ^ {x}) "
                     f"+ bit_count({x}) <= {most}"))


def _sliced(pairs: Callable[[Column], DataFrame]) -> DataFrame:
    """The distinct rows of ``pairs(part)`` over all parts of the words, each part a write of its
    own, whose shuffle files go before the next one starts."""
    part = F.pmod(F.col("w"), F.lit(SLICES))
    return stash(reduce(DataFrame.union, [stash(pairs(part == i).distinct(), "line-part") for i in range(SLICES)])
                 .distinct(), "line-pairs")


def _verified(pairs: DataFrame, docs: DataFrame, ranks: DataFrame, groups: DataFrame) -> DataFrame:
    """(late): the sets of ``pairs`` (x, y) that truly match a set at an earlier place. The whole
    sets are made again, from the documents where they stand first."""
    need = stash(pairs.select(F.col("x").alias("s1")).union(pairs.select("y")).distinct()
                 .join(groups.select("s1", "doc", "line", "hash"), "s1"), "line-need")
    rows = need.count()
    if rows <= BROADCAST_ROWS:
        place = F.broadcast(need.select(*[F.col(c).alias(f"need_{c}") for c in ("doc", "line", "hash")]))
        ids = F.broadcast(need.select(F.col("doc").alias("need_doc")).distinct())
        split = (_split(docs.join(ids, F.col("doc").eqNullSafe(F.col("need_doc")), "left_semi"))
                 .join(place, F.expr("doc <=> need_doc and line = need_line and hash = need_hash"), "left_semi"))
    else:   # texts stay where they are: a table of fixed size passes nearly only the lines that are needed
        at = F.xxhash64("doc", "line", "hash")
        bits = pii.bit_table(need.select(at.alias("w")))
        split = _split(docs).withColumn("bits", bits.scalar()).filter(pii.in_bit_table(at, "bits")).drop("bits")
    made = _sets(split, ranks)
    sets = (made.select("s1", "n", "words").join(small(need.select("s1"), rows), "s1", "left_semi")
            .dropDuplicates(["s1"]).join(need, "s1").withColumn("at", F.struct("doc", "line", "hash")).drop("doc", "line", "hash"))
    sets = stash(sets, "line-sets")
    x = sets.select(F.col("s1").alias("x"), F.col("words").alias("xw"), F.col("at").alias("xa"))
    y = sets.select(F.col("s1").alias("y"), F.col("words").alias("yw"), F.col("at").alias("ya"))
    return (pairs.join(y, "y").join(x, "x").withColumn("o", F.size(F.array_intersect("xw", "yw")))
            .filter(f"{DEN} * o >= {NUM} * (size(xw) + size(yw) - o)").filter("xa <> ya")
            .select(F.when(F.col("xa") < F.col("ya"), F.col("y")).otherwise(F.col("x")).alias("s1")).distinct())


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``text`` less the removed lines, and n_lines, n_removed, removed (line
    numbers from 0), replaced if such columns exist.

    Lines end at a line feed; a line without words is never removed. A null text stays null with
    no lines; an empty one has one blank line. Rows of equal id and text are one document given
    twice and are treated alike. A null id comes before all others.
    """
    base = docs.select(F.col(id_col).alias("doc"), F.col(text).alias("text"))
    ranks = stash(_ranks(base), "ranks")
    lines = _sets(_split(base), ranks)
    probe = F.expr(f"n - {_need('n')} + 1")
    # lines of equal sets, at their first place; the prefix and the parities follow from the set
    groups = (lines.select("s1", "n", "doc", "line", "hash", *_signature(), F.slice("words", F.lit(1), probe).alias("prefix"))
              .groupBy("s1", "n", *SIGNATURE, "prefix").agg(F.min(F.struct("doc", "line", "hash")).alias("at"))
              .select("s1", "n", *SIGNATURE, "prefix", "at.doc", "at.line", "at.hash"))
    groups = stash(groups, "line-groups")
    shorter = F.expr(f"n - {_need('n', 'n')} + 1")

    # each line against the earliest line of each word of its shorter prefix
    def tried(part: Column) -> DataFrame:
        a = F.struct("doc", "line", "s1", "n", *SIGNATURE, "place")
        return (groups.select("s1", "n", *SIGNATURE, "doc", "line", F.posexplode(F.slice("prefix", F.lit(1), shorter)).alias("place", "w"))
                .filter(part)
                .repartition("w").select(a.alias("a"), "w")   # dealt out before, so that the struct is sent once
                .select("a", F.min("a").over(Window.partitionBy("w")).alias("b"))
                .filter((F.col("a.s1") != F.col("b.s1")) & _passes("a", "b"))
                .select(F.col("a.s1").alias("x"), F.col("b.s1").alias("y")))

    late = stash(_verified(_sliced(tried), base, ranks, groups), "line-late")
    closed = late.withColumn("closed", F.lit(True))
    marked = groups.join(small(closed, late.count()), "s1", "left").withColumn("open", F.col("closed").isNull())

    # what is left, if the later line of the two is open; most rows that meet fail by n and place alone, the rest is read after
    more = marked.select("n", "prefix", F.struct("s1", *SIGNATURE, "doc", "open").alias("z"))
    later = F.expr("case when a.z.doc <=> b.z.doc then a.z.open or b.z.open "
                   "when a.z.doc is null or a.z.doc < b.z.doc then b.z.open else a.z.open end")

    def rest(part: Column) -> DataFrame:
        a, b = (more.select("n", "z", F.posexplode(F.slice("prefix", F.lit(1), length)).alias("place", "w"))
                .filter(part).alias(side) for side, length in (("a", shorter), ("b", probe)))
        return (a.join(b, (F.col("a.w") == F.col("b.w")) & F.expr("a.n < b.n or (a.n = b.n and a.z.s1 < b.z.s1)")
                       & _passes("a", "b", ".z") & later)
                .select(F.col("a.z.s1").alias("x"), F.col("b.z.s1").alias("y")))

    late = stash(late.union(_verified(_sliced(rest), base, ranks, groups)).distinct(), "line-late")

    # a line stays if it stands at the first place of its set and no earlier line matches the set
    stay = groups.join(small(late, late.count()), "s1", "left_anti").select("doc", "line", "hash")
    every = _split(base).select("doc", "line", "hash")
    gone = (every.alias("e").join(stay.alias("s"), F.expr("e.doc <=> s.doc and e.line = s.line and e.hash = s.hash"), "left_anti")
            .groupBy("doc").agg(F.collect_set(F.xxhash64("line", "hash")).alias("__gone"))
            .select(F.col("doc").alias("__doc"), "__gone"))
    gone = stash(gone, "line-gone")
    gone_size = gone.agg(F.coalesce(F.sum(F.size("__gone") + 2), F.lit(0))).first()[0]   # numbers it holds
    rows = docs.join(small(gone, gone_size), docs[id_col].eqNullSafe(F.col("__doc")), "left").drop("__doc")
    parts = F.split(F.col(text), "\n", -1)
    goes = F.when(F.col("__gone").isNotNull(), F.transform(parts, lambda t, i: F.array_contains(
        "__gone", F.xxhash64(i, F.xxhash64(t)))))
    rows = (rows.withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.size(parts)))
            .withColumn("__goes", goes).drop("__gone"))
    removed = F.filter(F.transform("__goes", lambda x, i: F.when(x, i)), lambda x: x.isNotNull())
    left = F.array_join(F.transform(F.filter(F.arrays_zip(parts.alias("t"), F.col("__goes").alias("x")), lambda z: ~z["x"]),
                                    lambda z: z["t"]), "\n")
    return (rows.withColumn("removed", F.coalesce(removed, F.array().cast("array<int>")))
            .withColumn("n_removed", F.size("removed"))
            .withColumn(text, F.when(F.col("n_removed") > 0, left).otherwise(F.col(text))).drop("__goes"))
