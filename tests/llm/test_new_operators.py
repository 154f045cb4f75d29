"""Whitening, toxicity and spelling variants against plain versions, and on hard rows."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from ladderkit.llm import common, spelling, toxicity, whitening
from tests.conftest import SF001
from tests.llm.test_operators import HARD


@pytest.fixture(scope="module")
def hard(spark):
    df = spark.createDataFrame(HARD, "doc_id long, text string, lang string").repartition(3)
    for name in ("k", "t", "word", "n", "gram", "near", "root", "label", "x", "piece", "__key", "v", "component"):
        df = df.withColumn(name, F.lit("clash"))
    return df


# 11 -----------------------------------------------------------------------------

def plain_whitening(vectors, k=32):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1000000
    n, s = len(x), x.sum(axis=0)
    d = n * x - s
    e, u = np.linalg.eigh((d / n).T @ (d / n) / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return (d * d).sum(axis=1), (d / n) @ u / np.sqrt(e), e / ((d / n) ** 2).sum() * n


def test_whitening_query(spark):
    got = E.queries()["op11_embedding_whitening"](spark, SF001).toPandas()
    rows = common.table(spark, SF001, "embeddings").toPandas()
    deviation, white, explained = plain_whitening(rows.embedding.tolist())
    assert len(got) == 32 * len(rows) and (got.n == len(rows)).all() and got.residual_certified.all()
    assert dict(zip(got.vec_id, got.deviation)) == dict(zip(rows.vec_id, deviation))
    w = got.pivot(index="vec_id", columns="component", values="whitened").loc[rows.vec_id].to_numpy()
    assert np.abs(w * np.sign((w * white).sum(axis=0)) - white).max() < 1e-9
    assert np.allclose(got.groupby("component").explained.first(), explained, rtol=1e-10)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10


@pytest.mark.parametrize("values", [np.ones(90), 10.0 ** -np.linspace(0, 9, 90), np.r_[np.ones(5), np.zeros(85)],
                                    0.5 ** np.arange(90), 1 + 1e-6 * np.arange(90)[::-1], np.zeros(90)])
def test_filtered_subspace_iteration(values):
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((90, 90)))[0]
    v = (q * values) @ q.T
    got = whitening.leading(90, 20, lambda y: v @ y, values.sum())
    k = int((values[:20] > 1e-11 * values[0]).sum()) if values[0] else 0
    assert got.certified and len(got.values) == k
    assert np.allclose(got.values, values[:k], rtol=1e-5)
    assert not k or np.abs(v @ got.components - got.components * got.values).max() < 1e-12


def test_whitening_hard_rows(spark):
    schema = "vec_id long, embedding array<float>, component string"
    rnd = random.Random(1)
    good = [(i % 30, [rnd.gauss(0, 1) for _ in range(4)] + [0.5], "x") for i in range(60)]
    bad = [(90, None, "x"), (91, [1.0, None, 2.0, 0.0, 0.0], "x"), (92, [float("nan")] * 5, "x"), (93, [float("inf")] * 5, "x"),
           (94, [], "x"), (95, [1.0], "x"), (96, [3e38] * 5, "x")]
    df = spark.createDataFrame(good + bad + [(None, good[0][1], "x")], schema)
    got = whitening.whiten(df.select("vec_id", "embedding"), "vec_id", "embedding").toPandas()
    assert len(got) == 61 * 4 and set(got.component) == {1, 2, 3, 4}      # the constant dimension has no component
    assert got.vec_id.isna().sum() == 4 and not set(got.vec_id.dropna()) & set(range(90, 97))
    x = spark.createDataFrame([(i, [1.0, 2.0], "x") for i in range(3)], schema)
    assert whitening.whiten(x, "vec_id", "embedding").count() == 0
    assert whitening.whiten(df.limit(0), "vec_id", "embedding").count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, "x")], schema), "vec_id", "embedding").count() == 0


def test_deviations_are_exact_or_null():
    c = whitening.Centre(10 ** 7, [10 ** 13 + 3, 10 ** 13 - 5])
    assert c.squared(np.array([[1_000_100, 999_990]])) == [(10 ** 9 - 3) ** 2 + (5 - 10 ** 8) ** 2]
    assert c.squared(np.array([[10 ** 9, 1_000_000]])) == [None]


# 12 -----------------------------------------------------------------------------

def plain_kernel(a, b):
    """Gap-weighted subsequences of three symbols within the span; (symbol, place) pairs."""
    def feature(x):
        out = defaultdict(float)
        for t in combinations(x, 3):
            span = t[2][1] - t[0][1] + 1
            if span <= toxicity.SPAN:
                out[tuple(s for s, _ in t)] += toxicity.DECAY ** (span - 3)
        return out
    fa, fb = feature(a), feature(b)
    dot = sum(v * fb.get(k, 0) for k, v in fa.items())
    return (dot / np.sqrt(sum(v * v for v in fa.values()) * sum(v * v for v in fb.values()))) ** toxicity.POWER


def test_string_kernel_against_plain_version():
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcé*-") for _ in range(rnd.randint(1, 14))) for _ in range(40)] + ["idiot", "i*d*i*o*t", "idxiot", "aaaaaaa"]
    owner, symbols, places = toxicity.pieces(words)
    listed = [[(int(s), int(p)) for s, p in zip(a, b) if s] for a, b in zip(symbols, places)]
    marks = toxicity.Landmarks.of(symbols, places)
    got = marks.kernel(symbols, places)
    for i in range(len(listed)):
        for j in range(0, len(listed), 3):
            assert got[i, j] == pytest.approx(plain_kernel(listed[i], listed[j]), abs=1e-5)
    assert set(owner) == {i for i, w in enumerate(words) if re.search("[abcdéiotx]", w)}
    by = {words[o]: i for i, o in enumerate(owner) if len(words[o]) < 7 or words[o][1] == "*"}
    assert got[by["idxiot"], by["idiot"]] > 0.1 and got[by["i*d*i*o*t"], by["idiot"]] > 0.1


def test_sentences():
    s = toxicity.split(["One two. three\nfour", None, "", "you i d i o t here", "w " * 100])
    assert s.count.tolist() == [4, 0, 0, 7, 100] and "i d i o t" in s.distinct
    assert s.text.tolist() == [0, 0, 0, 3, 4, 4, 4]
    assert (np.diff(s.sentence[:111]) >= 0).all()


def test_toxicity_query_and_gapped_insults(spark, hard):
    rnd = random.Random(2)
    plain = ["table", "garden", "window", "river", "mountain", "summer", "letter", "paper", "yellow", "orange", "stone", "cloud"]
    rude = ["idiot", "scum", "moron", "worthless"]
    rows, labels = [], []
    for i in range(600):
        w = [rnd.choice(plain) for _ in range(rnd.randint(8, 60))]
        if i % 4 == 0:
            for _ in range(1 + len(w) // 20):
                w.insert(rnd.randrange(len(w)), rnd.choice(rude))
        rows.append((i, " ".join(w) + "."))
        labels.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels + [(1, None), (None, 1), (2, 7)], "doc_id long, label int"))
    tests = ["the garden was a yellow table near the river and stone", "you idiot of a table in the garden near the river",
             "you i.d.i.o.t of a table in the garden near the river", "you i d i o t of a table in the garden near the river",
             "you moxron of a table, idixot of a window", "WORTHLESS paper. cloud", None, ""]
    s = model.score(tests)
    assert s[0] < 0.3 and s[6] < 0.3 and s[7] == s[6] and (s[1:6] >= 0.3).all(), s
    got = toxicity.add_score(hard, model, ["doc_id", "n"]).toPandas()
    assert len(got) == len(HARD) and got.score.between(0, 1).all()
    assert toxicity.add_score(hard.limit(0), model, ["doc_id"]).count() == 0
    none = spark.createDataFrame([], "doc_id long, label int")
    assert toxicity.fit(docs, none).score(["a"])[0] == 0.5
    assert toxicity.fit(docs.limit(0), none).constant == 0.5
    out = E.queries()["op12_toxicity"](spark, SF001).toPandas()
    assert [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id] == out.held_out.tolist()
    assert ((out.score >= 0.3) == (out.predicted == 1)).all() and out.score.between(0, 1).all() and len(out) == 200


# 13 -----------------------------------------------------------------------------

def plain_words(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def is_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(n):
    out = {}
    for w in n:
        near = [x for x in n if is_near(w, x)]
        top = min(near, key=lambda x: (-n[x], x), default=None)
        out[w] = (top if top and n[top] >= 5 * n[w] else None, len(near))
    rows = {}
    for w, (form, k) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows[w] = (form, root, n[w], k, n[form] if form else None)
    return rows


def as_rows(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_variants_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in common.table(spark, SF001, "documents").collect()]
    got = as_rows(E.queries()["op13_spelling_variants"](spark, SF001))
    assert got == plain_variants(plain_words(docs)) and any(r[0] for r in got.values())


def test_variants_of_dense_random_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "RARE", 3)
    monkeypatch.setattr(spelling, "BLOCK", 20)
    rnd = random.Random(6)
    n = {}
    for _ in range(400):
        w = "".join(rnd.choice("abé") for _ in range(rnd.randint(6, 9)))
        n[w] = rnd.choice([5, 6, 25, 30, 125, 700, 700])
    n["a" * 3000], n["a" * 3001] = 5, 25
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert as_rows(spelling.group_variants(df)) == plain_variants(n)


def test_affected_grams():
    """The two grams a word merges share no place, whatever the dictionary holds."""
    rnd = random.Random(8)
    for _ in range(300):
        w = "^" + "".join(rnd.choice("ab") for _ in range(rnd.randint(6, 12))) + "$"
        inner = {w[p:p + q]: rnd.randint(1, 9) for p in range(len(w)) for q in range(2, 6) if rnd.random() < 0.7}
        grams = spelling._grams(w, inner)
        (p, a), (q, b) = spelling._cheapest_pair(grams, inner)
        assert p + len(a) <= q and w[p:p + len(a)] == a and w[q:q + len(b)] == b


def test_variants_hard_rows(spark, hard):
    got = as_rows(spelling.group_variants(spelling.count_words(hard)))
    assert got == plain_variants(plain_words([(i, t) for i, t, _ in HARD]))
    assert spelling.group_variants(spelling.count_words(hard.limit(0))).count() == 0
