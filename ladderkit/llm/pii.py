"""Personal data: fixed kinds found by pattern, and terms that give a protected value away.

Base spans are the leftmost non-overlapping matches of each kind that pass its check. The values
found are the protected entities. Corpus co-occurrence then estimates how strongly a term reveals
a value, both counted over whole documents: with N documents and p = df(value) / N, the
information of a value is log(1 / p), and what a term tells of it is the smoothed pointwise mutual
information log(q / p), where q = (co + PRIOR p) / (df(term) + PRIOR) is the chance of the value
where the term stands, drawn towards p as by ``PRIOR`` documents of no news. Smoothing weighs
scarce evidence without a least count, so values of one document have terms too. A term that tells
at least ``SHARE`` of the value's information exceeds the disclosure threshold and becomes a span
of kind ``term`` wherever it stands outside base spans, in documents with the value and in all
others: generalised to its stem where the stem stays below the threshold, else removed. Terms are
compared by 64 bits of their hash. All of it runs as DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

KINDS = ["email", "ip", "card", "phone", "term"]
PRIOR = 0.5        # documents
SHARE = 0.9
STEM = 4
TABLE_BITS = 1 << 23   # of the disclosing terms; false passes only cost a row
_WORD = r"\p{L}{3,}"

# The four patterns of the contract. Repetitions are possessive where nothing can be given back,
# and a run is tried only from its first character or from the end of the last match, which gives
# the same matches in linear time and without deep recursion.
_LOCAL = "[A-Za-z0-9._%+-]"
_PATTERN = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_MAYBE = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_SPAN = "array<struct<s:int,e:int,value:string>>"


def _luhn(digits: Column) -> Column:
    """Whether the check sum of a digit string is a multiple of ten."""
    n = F.length(digits)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + _luhn_digit(digits, n, i))
    return total % 10 == 0


def _luhn_digit(digits: Column, n: Column, i: Column) -> Column:
    d = F.substring(digits, i, F.lit(1)).cast("int")
    twice = d * 2
    return F.when((n - i) % 2 == 1, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(d)


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    digits = F.translate(value, " -().+", "")
    n = F.length(digits)
    if kind == "phone":
        return n.between(9, 15)
    return F.when(n.between(13, 19), _luhn(digits)).otherwise(F.lit(False))


def _matches(text: Column, pattern: str, valid) -> Column:
    """Every match that is ``valid``, with its place in code points."""
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # one more gap than matches: the last zipped entry has no match
    parts = F.arrays_zip(hits.alias("h"), gaps.alias("a"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["a"])
        e = s + F.length(x["h"])
        span = F.struct(s.alias("s"), e.alias("e"), x["h"].alias("value"))
        return F.struct(e.alias("at"), F.when(valid(x["h"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))
    return F.aggregate(F.filter(parts, lambda x: x["h"].isNotNull()), start, step, lambda acc: acc["out"])


def _kind_spans(text: Column, k: int) -> Column:
    spans = _matches(text, _PATTERN[KINDS[k]], lambda value: _valid(KINDS[k], value))
    return F.transform(spans, lambda x: F.struct(
        F.lit(k).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["value"].alias("value")))


def _of_kind(k: int) -> Column:
    return F.filter("spans", lambda x: x["kind"] == k)


def _words(text: Column) -> Column:
    """The distinct words of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), F.lower))


def base_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, h1, h2, spans, words): h1 and h2 hash the text (null as empty), spans are structs of
    kind, s, e and value, in the order of kind and start, words the distinct words of a text with spans."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), t.alias("t"), F.xxhash64(t).alias("h1"),
                       F.xxhash64(t, F.lit(1)).alias("h2"))
    found = []
    for k, kind in enumerate(KINDS[:4]):
        maybe = F.col("t").contains("@") if kind == "email" else F.col("t").rlike(_MAYBE[kind])
        rows = rows.withColumn(f"s{k}", F.when(maybe, _kind_spans(F.col("t"), k)))
        found.append(f"s{k}")
    empty = F.array().cast("array<struct<kind:int," + _SPAN[13:])
    rows = rows.withColumn("spans", F.concat(*[F.coalesce(F.col(c), empty) for c in found]))
    return rows.select("doc_id", "h1", "h2", "spans", F.when(F.size("spans") > 0, _words(F.col("t"))).alias("words"))


def _entity(x: Column) -> Column:
    """A value's identity: e-mail in lower case, digits of cards and phones."""
    plain = F.when(x["kind"] >= 2, F.translate(x["value"], " -().+", "")).otherwise(F.lower(x["value"]))
    return F.xxhash64(x["kind"], plain)


def _stem(term: Column) -> Column:
    return F.concat(F.left(term, F.lit(STEM)), F.lit("*"))


def _share(co: Column, df: Column, p: Column) -> Column:
    """The share of a value's information that a term tells."""
    q = (co + PRIOR * p) / (df + PRIOR)
    return F.log(q / p) / -F.log(p)


def _pairs(spans: DataFrame) -> DataFrame:
    """(id, n, w, s, co): how many documents hold a word w and a class of values, and n, how many
    hold the class; s is the word's stem, null where w is itself a stem.

    Equal texts are looked at once, with their number. Values that stand in the same texts tell the
    same and are one class, so a long list of values does not meet each word of its text.
    """
    ents = F.array_distinct(F.transform("spans", _entity))
    texts = (spans.filter(F.size("spans") > 0).select("h1", "h2", F.struct(ents.alias("ents"), "words").alias("one"))
             .groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.any_value("one").alias("one")))
    held = texts.select("h1", "h2", "copies", F.explode("one.ents").alias("ent"))
    classes = (held.groupBy("ent").agg(F.sum("copies").alias("n"), F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
               .select("ent", F.struct(F.xxhash64("x1", "x2", "n").alias("id"), "n").alias("class")))
    dealt = held.join(classes, "ent").groupBy("h1", "h2").agg(F.collect_set("class").alias("classes"))
    words = F.concat(
        F.transform("one.words", lambda w: F.struct(F.xxhash64(w).alias("w"), F.xxhash64(_stem(w)).alias("s"))),
        F.transform(F.array_distinct(F.transform("one.words", _stem)),
                    lambda w: F.struct(F.xxhash64(w).alias("w"), F.lit(None).cast("long").alias("s")))).cast("array<struct<w:long,s:long>>")
    return (texts.join(dealt, ["h1", "h2"]).select("copies", F.explode("classes").alias("c"), words.alias("words"))
            .select("c.*", "copies", F.explode("words").alias("x")).groupBy("id", "n", "x.w", "x.s")
            .agg(F.sum("copies").alias("co")))


def disclosing_terms(docs: DataFrame, spans: DataFrame, text: str = "text") -> DataFrame:
    """(w, generalise): the hashes of the terms that exceed the threshold for a value.

    Document frequencies count every document and word of the corpus; a document adds one row a
    distinct word, summed up before the shuffle.
    """
    words = _words(F.col(text))
    both = F.concat(words, F.array_distinct(F.transform(words, _stem)))
    df = (docs.select(F.explode(both).alias("w")).select(F.xxhash64("w").alias("w"))
          .groupBy("w").agg(F.count("*").alias("df")))
    total = docs.agg(F.count("*").alias("n")).scalar()
    scored = (_pairs(spans).join(df, "w").withColumn("p", F.col("n") / total)
              .withColumn("share", F.when(F.col("p") < 1, _share(F.col("co"), F.col("df"), F.col("p")))))
    over = stash(scored.filter(F.col("share") >= SHARE).select("id", "w", "s"), "over")
    stems = over.filter(F.col("s").isNull()).select("id", F.col("w").alias("s"), F.lit(False).alias("open"))
    return (over.filter(F.col("s").isNotNull()).join(stems, ["id", "s"], "left")
            .groupBy("w").agg(F.min(F.coalesce("open", F.lit(True))).alias("generalise")))


def _bit(w: Column) -> Column:
    return w.bitwiseAND(F.lit(TABLE_BITS - 1))


def bit_table(terms: DataFrame) -> DataFrame:
    """One row, ``bits``: a bit table of the terms' hashes, as numbers of 64 bits."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)).cast("int"))
    some = (terms.select(_bit(F.col("w")).alias("bit")).select(F.shiftright("bit", 6).alias("id"), one.alias("one"))
            .groupBy("id").agg(F.bit_or("one").alias("v")))
    full = (terms.sparkSession.range(TABLE_BITS >> 6).join(some, "id", "left")
            .select(F.struct("id", F.coalesce("v", F.lit(0).cast("long")).alias("v")).alias("x")))
    return full.agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["v"]).alias("bits"))


def in_bit_table(h: Column, bits: str) -> Column:
    bit = _bit(h)
    row = F.element_at(F.col(bits), F.shiftright(bit, 6).cast("int") + 1)
    return F.getbit(row, bit.bitwiseAND(F.lit(63)).cast("int")) == 1


def _marks(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """(h1, h2, terms): every occurrence of a term in the whole of each distinct text."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(t.alias("t"), F.xxhash64(t).alias("h1"), F.xxhash64(t, F.lit(1)).alias("h2"),
                       bit_table(terms).scalar().alias("bits"))

    def maybe(word: Column) -> Column:
        return in_bit_table(F.xxhash64(F.lower(word)), "bits")

    found = rows.select("h1", "h2", F.transform(_matches(F.col("t"), _WORD, maybe), lambda x: F.struct(
        x["s"].alias("s"), x["e"].alias("e"), F.xxhash64(F.lower(x["value"])).alias("w"))).alias("terms"))
    return (found.filter(F.size("terms") > 0).groupBy("h1", "h2").agg(F.any_value("terms").alias("terms"))
            .select("h1", "h2", F.explode("terms").alias("x")).select("h1", "h2", "x.*").join(terms, "w")
            .groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("s", "e", "generalise"))).alias("terms")))


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, h1, h2, spans, terms) of every row: ``spans`` as of :func:`base_spans`, ``terms``
    structs (s, e, generalise), in the order of their places.

    A null text counts as empty; a repeated row counts as another document and gets the same
    spans; extra columns are ignored.
    """
    spans = stash(base_spans(docs, id_col, text), "spans")
    terms = stash(disclosing_terms(docs, spans, text), "terms")
    hits = _marks(docs, terms, text)
    clear = F.filter("terms", lambda w: ~F.exists("spans", lambda x: (x["s"] < w["e"]) & (w["s"] < x["e"])))
    none = F.array().cast("array<struct<s:int,e:int,generalise:boolean>>")
    return (spans.drop("words").join(hits, ["h1", "h2"], "left")
            .select("doc_id", "h1", "h2", "spans", F.coalesce(clear, none).alias("terms")))


def _listed(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string")))


def digest(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans and all spans as text, per document."""
    count = [F.size(_of_kind(k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])]
    own = F.transform("terms", lambda x: F.concat_ws(":", F.lit("term"), x["s"].cast("string"), x["e"].cast("string")))
    return found.select("doc_id", *count, F.sha2(F.array_join(_listed(F.col("spans")), ","), 256).alias("base_sha256"),
                        F.array_join(F.concat(_listed(F.col("spans")), own), ",").alias("spans"),
                        F.size("terms").cast("long").alias("n_term"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every value replaced by its kind in brackets and every disclosing term by its
    stem or ``[TERM]``; of overlapping spans the one that starts first is shown, all are covered."""
    found = find(docs, id_col, text).select("h1", "h2", "spans", "terms").dropDuplicates(["h1", "h2"])
    t = F.coalesce(F.col(text), F.lit(""))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    base = F.transform("__spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.element_at(names, x["kind"] + 1).alias("by")))
    own = F.transform("__terms", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.when(
        x["generalise"], F.concat(F.substring(F.col(text), x["s"] + 1, F.lit(STEM)), F.lit("*"))).otherwise(F.lit("[TERM]")).alias("by")))

    def step(acc: Column, x: Column) -> Column:
        fresh = F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, x["s"] - acc["at"]), x["by"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"),
                        F.when(x["s"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate(F.array_sort(F.concat(base, own)), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                        lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(text))))
    return (docs.withColumn("__h1", F.xxhash64(t)).withColumn("__h2", F.xxhash64(t, F.lit(1)))
            .join(found.select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), F.col("spans").alias("__spans"),
                               F.col("terms").alias("__terms")), ["__h1", "__h2"], "left")
            .withColumn(text, F.when(F.size("__spans") + F.size("__terms") > 0, clean).otherwise(F.col(text)))
            .drop("__h1", "__h2", "__spans", "__terms"))
