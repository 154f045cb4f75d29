"""Corpus operators against brute force, on the smallest tables and on hard rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as E
from ladderkit.llm import (common, decontaminate, jaccard, language, lines, packing, pii, quality, repair, sharding,
                           tokens, topk)
from ladderkit.llm.queries import scored_documents
from tests.conftest import SF001
from tests.llm import brute as B

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"word{i % 977} to" for i in range(30_000))
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
HARD = [
    (1, None, "en"), (2, "", "en"), (3, " \n\t \n", None), (4, "a", "en"), (5, BASE + "\n" + BASE, "en"), (6, BASE, None),
    (7, BASE, "en"), (7, BASE, "en"), (8, BASE + " extra", "en"), (9, LONG, "en"), (10, "mail a@b.co now\nA\nA", "de"),
    (11, "12.34.56.78 and 1.2.3.4.5.6.7.8 300.1.1.1", "de"), (12, "card 4111 1111 1111 1111, +44 (20) 7946-0958", "de"),
    (13, "é ß 中文 \U0001F600\r\nΑΒΓ", "fr"), (14, "a.b@c.de_f@g.hi x@y@z.org", "de"), (15, "<|endoftext|> tail", "en"),
    (None, "no id but words enough to count here", "en"), (16, "1" * 5000 + " " + "9 " * 3000 + "." * 100, None),
]


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls, blanks, long texts, ties, repeated rows, and columns whose names clash with inner ones."""
    df = spark.createDataFrame(HARD, "doc_id long, text string, lang string").repartition(3)
    for name in ("id", "t", "n", "line", "hash", "words", "node", "start", "spans", "slot", "stats", "label", "block", "h1"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def none(hard):
    return hard.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, SF001, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def run(spark, name):
    return E.queries()[name](spark, SF001).toPandas()


# 1 ------------------------------------------------------------------------------

def test_language_held_out_accuracy(spark, docs):
    got = run(spark, "op1_language_mixture").merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id] == got.held_out.tolist()
    assert (got.lang_pred == got.lang)[got.held_out].mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_mixture_and_hard_rows(spark, docs, hard, none):
    names, probs = language.fit(docs)
    one = {lang: " ".join(t for (t,) in docs.filter(F.col("lang") == lang).select("text").limit(8).collect()) for lang in ("en", "de")}
    share = language.mixtures([one["en"][:2000] + " " + one["de"][:2000], one["en"], "123 ..."], probs)
    assert sorted(names[i] for i in np.flatnonzero(share[0])) == ["de", "en"] and 0.3 < share[0].max() < 0.7
    assert names[share[1].argmax()] == "en" and share[1].max() == pytest.approx(1) and share[2].sum() == 0
    got = language.predict(hard, names, probs, ["doc_id", "n"]).toPandas()
    assert len(got) == len(HARD) and set(got[got.doc_id.isin([1, 2, 3])].lang_pred) == {"und"}
    assert language.predict(none, names, probs, ["doc_id"]).count() == 0
    assert language.fit(none)[0] == []
    assert set(language.predict(hard, *language.fit(none), ["doc_id"]).toPandas().lang_pred) == {"und"}


# 2 ------------------------------------------------------------------------------

def check_base(got, text_of):
    for r in got.itertuples():
        text = text_of(r)
        spans = B.base_spans(text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in spans) for x in B.KINDS]
        assert r.base_sha256 == B.base_digest(text)
        assert r.spans.startswith(",".join(f"{k}:{s}:{e}" for k, s, e in spans))


def test_pii_base_spans(spark, texts, hard, none):
    check_base(run(spark, "op2_pii_disclosure"), lambda r: texts[r.doc_id])
    by_id = {i: t for i, t, _ in HARD}
    got = pii.digest(pii.find(hard)).toPandas()
    assert len(got) == len(HARD)
    check_base(got, lambda r: by_id[None if pd.isna(r.doc_id) else int(r.doc_id)])
    assert pii.digest(pii.find(none)).count() == 0


def test_pii_random_strings(spark):
    rnd = random.Random(3)
    rows = [(i, "".join(rnd.choice("a.@-_+() 1234567890\n") for _ in range(rnd.randint(0, 80)))) for i in range(600)]
    text = dict(rows)
    check_base(pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).toPandas(), lambda r: text[r.doc_id])


def test_pii_disclosing_terms_are_found_and_sanitised(spark):
    rows = [(i, f"reach zorblatt at boss@corp.example about plans {i}") for i in range(4)]
    rows += [(100 + i, f"plans about nothing at all reach far {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(df)).collect()}
    s = rows[0][1].index("zorblatt")
    assert got[0].split(",") == [f"email:{s + 12}:{s + 29}".replace(f"{s + 29}", str(rows[0][1].index("boss") + 17)), f"term:{s}:{s + 8}"]
    assert got[100] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert "zorblatt" not in clean[0] and "[EMAIL]" in clean[0] and "reach" in clean[0] and clean[100] == rows[4][1]


def test_pii_values_of_one_document_have_terms(spark):
    rows = [(0, "reach zorblatt at boss@corp.example about plans"), (1, "reach a desk at desk@corp.example about plans")]
    rows += [(100 + i, f"plans about the desk and reach far {i}") for i in range(200)]
    got = {r["doc_id"]: r for r in pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[0]["spans"].endswith(",term:6:14") and got[0]["n_term"] == 1 and got[1]["n_term"] == 0


def test_pii_terms_are_counted_and_marked_over_whole_texts(spark):
    far = "nothing of note " * 20
    rows = [(i, f"Hopkinson, 42 elm street, card 4111 1111 1111 1111 {far}signed HOPKINSON {i}") for i in range(4)]
    rows += [(9, "hopkinson of elm street, card lost")]
    rows += [(100 + i, f"{far}signed elm street card {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"].split(",") for r in pii.digest(pii.find(df)).collect()}
    at = rows[0][1].index("HOPKINSON")
    assert got[0][1:] == ["term:0:9", f"term:{at}:{at + 9}"] and got[9] == ["term:0:9"] and got[100] == [""]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert all("hopkinson" not in t.lower() for t in clean.values())


def test_pii_terms_occur_on_the_given_tables(spark, texts):
    got = run(spark, "op2_pii_disclosure")
    assert got.n_term.sum() > 0
    assert (got.spans.str.count("term:") == got.n_term).all()
    want = disclosing(texts)
    assert {r.doc_id: [x for x in r.spans.split(",") if x.startswith("term:")] for r in got.itertuples()} == want


def disclosing(texts):
    """{id: term spans} by plain counts over whole documents."""
    words = {i: [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]{3,}", t or "")] for i, t in texts.items()}
    base = {i: B.base_spans(t) for i, t in texts.items()}
    held, df = defaultdict(set), Counter(w for ws in words.values() for w in {w for _, _, w in ws})
    for i, spans in base.items():
        for kind, s, e in spans:
            value = texts[i][s:e]
            held[kind, re.sub("[^0-9]", "", value) if kind in ("card", "phone") else value.lower()].add(i)
    over = set()
    for ids in held.values():
        p = len(ids) / len(texts)
        for w, co in Counter(w for i in ids for w in {w for _, _, w in words[i]}).items():
            q = (co + pii.PRIOR * p) / (df[w] + pii.PRIOR)
            if math.log(q / p) >= pii.SHARE * math.log(1 / p):
                over.add(w)
    return {i: [f"term:{s}:{e}" for s, e, w in ws if w in over and not any(a < e and s < b for _, a, b in base[i])]
            for i, ws in words.items()}


# 3 ------------------------------------------------------------------------------

def test_line_dedup(spark, texts):
    got = run(spark, "op3_line_dedup")
    want = {i: (t, gone) for i, t, gone in B.dedup_lines(list(texts.items()))}
    assert {r.doc_id: (r.text, list(r.removed)) for r in got.itertuples()} == want


def test_line_dedup_similar_lines_and_hard_rows(spark, hard, none):
    rnd = random.Random(1)
    vocab = [f"w{i}" for i in range(60)]
    rows = []
    base = [rnd.sample(vocab, rnd.randint(1, 40)) for _ in range(12)]
    for i in range(150):
        line = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 3)):
            line[rnd.randrange(len(line))] = rnd.choice(vocab)
        rows.append((i, "\n".join([" ".join(line), " ".join(rnd.choice(base))])))
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["text"], r["removed"]) for r in got} == {i: (t, g) for i, t, g in B.dedup_lines(rows)}
    out = lines.dedup_lines(hard)
    assert set(hard.columns) < set(out.columns)
    got = out.toPandas()
    assert len(got) == len(HARD)
    text = {(None if pd.isna(r.doc_id) else int(r.doc_id)): r.text for r in got.itertuples()}
    assert text[1] is None and text[2] == "" and text[5] == BASE and text[6] == "" and text[7] == "" and text[9] == LONG
    assert lines.dedup_lines(none).count() == 0


def test_line_dedup_first_pass_sends_postings_once(spark, monkeypatch):
    """Each posting meets its word's earliest line without a second shuffle and a join; lines of
    sizes as far apart as a match allows are found."""
    rnd, plans, inner = random.Random(4), [], lines._sliced

    def spy(pairs):
        plans.append(pairs(F.lit(True))._jdf.queryExecution().optimizedPlan().toString())
        return inner(pairs)

    monkeypatch.setattr(lines, "_sliced", spy)
    rows = []
    for i in range(120):
        line = [f"r{i}w{j}" for j in range(rnd.randint(1, 60))]
        more = [f"r{i}x{j}" for j in range(rnd.randint(0, len(line) // 2))]
        less = line[:rnd.randint(len(line) * 2 // 3, len(line))]
        rows += [(3 * i, " ".join(line)), (3 * i + 1, " ".join(line + more)), (3 * i + 2, " ".join(rnd.sample(less, len(less))))]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["text"], r["removed"]) for r in got} == {i: (t, g) for i, t, g in B.dedup_lines(rows)}
    assert len(plans) == 2 and "Join" not in plans[0] and plans[0].count("Repartition") == 1


def test_line_dedup_verifies_few_pairs(spark, monkeypatch):
    """Long lines with frequent words in common, and lines that are gone already, are not verified again."""
    rnd, counts, inner = random.Random(5), [], lines._sliced

    def spy(pairs):
        out = inner(pairs)
        counts.append(out.count())
        return out

    monkeypatch.setattr(lines, "_sliced", spy)
    vocab, rows = [f"v{i}" for i in range(1500)], []
    for i in range(20):
        line = [f"r{i}w{j}" for j in range(30)]
        rows += [(5 * i + k, " ".join([*line[:k], f"x{i}k{k}", *line[k + 1:]] if k else line)) for k in range(5)]
    rows += [(1000 + i, " ".join(rnd.sample(vocab, 210))) for i in range(60)]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["text"], r["removed"]) for r in got} == {i: (t, g) for i, t, g in B.dedup_lines(rows)}
    assert len(counts) == 2 and 80 <= counts[0] <= 90 and counts[1] <= 10, counts


# 4 ------------------------------------------------------------------------------

def check_pack(got, ids_of, capacity):
    for key, g in got.groupby("doc_id", dropna=False):
        ids, at = ids_of(key), 0
        for r in g.sort_values("start").itertuples():
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == B.crc(ids[at:at + r.length])
            at += r.length
        assert at == len(ids)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= capacity


def test_packing(spark, texts, hard, none):
    got = run(spark, "op4_packing")
    check_pack(got, lambda d: B.token_ids(WORD, texts[d]), 4096)
    assert got.length.sum() / (4096 * got.sequence_id.nunique()) > 0.9
    rows = hard.filter("doc_id is null or doc_id <> 7")
    by_id = {i: t for i, t, _ in HARD}
    check_pack(packing.pack(rows, WORD, capacity=64).toPandas(), lambda d: B.token_ids(WORD, by_id[None if pd.isna(d) else int(d)]), 64)
    assert packing.pack(none, WORD).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=40), st.booleans())
def test_windows_hold_every_piece_once(sizes, cut):
    got = packing.windows([(i, 0, s) for i, s in enumerate(sizes)], 100, cut)
    assert all(sum(p[2] for p in w) <= 100 for w in got)
    back = {}
    for w in got:
        for doc, start, size in w:
            back.setdefault(doc, []).append((start, size))
    for i, s in enumerate(sizes):
        at = 0
        for start, size in sorted(back[i]):
            assert start == at
            at += size
        assert at == s and (cut or len(back[i]) == 1)


def test_differencing_is_near_equal():
    rnd = random.Random(5)
    sizes = [rnd.randint(100, 1500) for _ in range(300)]
    loads = [sum(sizes[i] for i in s) for s in packing.difference(sizes, 40)]
    assert max(loads) - min(loads) < 0.02 * max(loads) and sum(loads) == sum(sizes)


# 5 ------------------------------------------------------------------------------

def test_topk(spark):
    rnd = random.Random(2)
    rows = [(i, [float(rnd.randint(-3, 3)) / 4 for _ in range(5)]) for i in range(700)]
    rows += [(1000, None), (1100, [0.5, None, 0.1, 0.0, 0.0]), (1200, [float("nan")] + [0.1] * 4), (1300, [float("inf")] + [0.0] * 4),
             (1400, [0.25, 0.5]), (1401, [1.0, -0.5]), (None, [0.1] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("salt", F.lit(9))
    v = topk.quantise(df, "embedding")
    got = topk.topk(v.filter("vec_id % 100 = 0"), v, 10).collect()
    ints = {i: [int(np.floor(1024 * x)) for x in e] for i, e in rows[:700]}
    want = B.top_k(ints, lambda i: i % 100 == 0, 10) + [(1400, 1, 1401, 256 * 1024 + 512 * -512)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.topk(v.limit(0), v, 3).count() == 0 and topk.topk(v.filter("vec_id = 0"), v.limit(0), 3).count() == 0


def test_topk_large_numbers_stay_exact():
    q, c = np.array([[2 ** 40, 3]], np.int64), np.array([[2 ** 20, 1], [2 ** 20, 2]], np.int64)
    assert topk._products(q, c).tolist() == [[2 ** 60 + 3, 2 ** 60 + 6]]


# 6 ------------------------------------------------------------------------------

def test_quality(spark, hard, none):
    got = run(spark, "op6_quality_classifier")
    known = got.merge(common.table(spark, SF001, "labels").toPandas(), on="doc_id")
    assert [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id] == got.held_out.tolist()
    assert (known.predicted == known.quality).mean() > 0.95 and got.score.between(0, 1).all()
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 17)] + [(None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    for few in (labels, labels.limit(0), labels.filter("quality = 1")):
        out = scored_documents(hard, few, lambda k: F.lit(True), ["doc_id", "n"]).toPandas()
        assert len(out) >= len(HARD) - 1 and out.score.between(0, 1).all()
    assert scored_documents(none, labels, lambda k: F.lit(True), ["doc_id"]).count() == 0


def test_quality_model_equals_numpy(spark, docs):
    stats = quality.add_statistics(docs, ["doc_id"])
    both = stats.join(common.table(spark, SF001, "labels").withColumnRenamed("quality", "label"), "doc_id")
    model, pdf = quality.fit(both), both.toPandas()
    x = np.array(pdf.stats.tolist())
    for c in (0, 1):
        assert np.allclose(model.mean[c], x[pdf.label == c].mean(axis=0))
    cov = [np.cov(x[pdf.label == c].T, bias=True) for c in (0, 1)]
    n = [(pdf.label == c).sum() for c in (0, 1)]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / sum(n)
    for c in (0, 1):
        s = (1 - quality.RIDGE) * (0.9 * cov[c] + 0.1 * pooled) + quality.RIDGE * np.diag(np.maximum(np.diag(pooled), 1e-6))
        assert np.allclose(model.factor[c] @ model.factor[c].T, s, atol=1e-8)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "one", "tail", " ", "  ", "\n", "<|", "|>", "é", "7"]),
                         max_size=8).map("".join), max_size=4))
def test_added_tokens_are_the_librarys(parts):
    for path, blanks in ((WORD, "dropped"), (BYTE, "leading")):
        encoder = tokens.Encoder.shared(open(path).read(), blanks, 2)
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(parts)] == [B.token_ids(path, t) for t in parts]


# 7 ------------------------------------------------------------------------------

def test_repair_table(spark, texts, hard, none):
    at = 0
    for r in run(spark, "op7_repair_tokens").sort_values("doc_id").itertuples():
        ids = B.token_ids(BYTE, texts[r.doc_id])
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), B.crc(ids))
        at += len(ids)
    rows = hard
    got = repair.read_documents(repair.encode_table(rows, BYTE, shard_ids=500)).orderBy("start").toPandas()
    want = sorted(HARD, key=lambda x: (x[0] is not None, x[0] or 0))
    assert [None if pd.isna(x) else int(x) for x in got.doc_id] == [x[0] for x in want]
    assert got.n_tokens.tolist() == [len(B.token_ids(BYTE, x[1])) for x in want]
    assert repair.read_documents(repair.encode_table(none, BYTE)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=300), st.data())
def test_repair_round_trip(ids, data):
    ids = np.array(ids, np.int64)
    seq, rules, first = repair.compress(ids, rounds=6, round_rules=4, min_count=2)
    assert repair.expand(seq, rules, first).tolist() == ids.tolist()
    shard = repair.Shard(seq, rules, repair.rule_lengths(rules, first), first, np.array([len(ids)]))
    a = data.draw(st.integers(0, len(ids)))
    n = data.draw(st.integers(0, len(ids) - a))
    assert shard.ids(a, n).tolist() == ids[a:a + n].tolist() and shard.document(0).tolist() == ids.tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aB'é 1\n\t\r ́.,!sSß中 \x1c", max_size=30), max_size=6))
def test_memo_gives_the_library_ids(some):
    for path, blanks in ((BYTE, "leading"), (WORD, "dropped")):
        enc = tokens.Encoder.shared(open(path, encoding="utf-8").read(), blanks, 2)
        for t, got in zip(some, enc.encode(some)):
            assert np.frombuffer(got, "<u4").tolist() == B.token_ids(path, t)


def test_small_memo_and_batches_give_the_library_ids(monkeypatch, texts):
    monkeypatch.setattr(tokens, "MEMO_BYTES", 50 * 270)
    monkeypatch.setattr(tokens, "BATCH_CHARS", 500)
    monkeypatch.setattr(tokens, "JOINED", 7)
    some = [*list(texts.values())[:60], None, "", " ", "x\n\ny", "\nx y\n", "É ΣΑΣ ﬁ"]
    for path, blanks in ((BYTE, "leading"), (WORD, "dropped")):
        enc = tokens.Encoder(open(path, encoding="utf-8").read(), blanks, 2)
        for _ in range(2):
            assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(some)] == [B.token_ids(path, t) for t in some]
        assert len(enc.memo) <= 50


# 8 ------------------------------------------------------------------------------

def test_sharding(spark, hard, none):
    names = [f"s{i}" for i in range(10)]
    owner = sharding.fill_table(names, 1009)
    count = np.bincount(owner)
    assert len(count) == 10 and count.max() - count.min() <= 1
    less = sharding.fill_table(names[:-1], 1009)
    moved = (owner != less) & (owner != 9)
    assert moved.mean() < 0.15
    got = run(spark, "op8_sharding")
    full = sharding.fill_table([f"shard-{i:05d}" for i in range(sharding.SHARDS)])
    assert (full[got.slot] == got["shard"]).all() and got.doc_id.is_unique
    assert sharding.place(hard, "doc_id").count() == len(HARD) and sharding.place(none, "doc_id").count() == 0
    for bad in ((names, 1008), ([], 1009), (["a", "a"], 1009)):
        with pytest.raises(ValueError):
            sharding.fill_table(*bad)


# 9 ------------------------------------------------------------------------------

def check_components(got, rows):
    want = B.components(rows)
    assert {(r["doc_id"], r["component_id"]) for r in got} == set(want.items())
    assert sorted((r["doc_id"], r["n_shingles"]) for r in got) == sorted((i, len(B.shingles(t))) for i, t in rows)


def test_jaccard(spark, texts, hard, none):
    check_components(E.queries()["op9_ngram_jaccard"](spark, SF001).collect(), list(texts.items()))
    check_components(jaccard.linked_components(hard).collect(), [(i, t) for i, t, _ in HARD if i is not None])
    assert jaccard.linked_components(none).count() == 0


def test_jaccard_groups_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TREE_SETS", 7)
    rnd = random.Random(11)
    rows = []
    for family in range(5):
        base = [f"w{rnd.randrange(40)}" for _ in range(rnd.randint(6, 120))]
        for _ in range(40):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 6])):
                w[rnd.randrange(len(w))] = f"w{rnd.randrange(60)}"
            rows.append((len(rows), " ".join(w[:rnd.choice([len(w), len(w), int(len(w) * 0.85)])])))
    rows += [(5, rows[100][1]), (6, "Only Here")]   # ids that repeat with other texts
    check_components(jaccard.linked_components(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {(r["node"], r["root"]) for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(51)} | {(i, 100) for i in range(100, 140)}


# 10 -----------------------------------------------------------------------------

def test_tiling(spark, texts, hard, none):
    items = common.table(spark, SF001, "benchmark")
    want = set()
    for r in items.collect():
        w = B.plain_words(r["text"])
        for d, t in texts.items():
            c = B.tiling(B.plain_words(t), w, 5) if set(w) & set(B.plain_words(t)) and len(t) < 5000 else 0
            if c >= 0.5 * len(w):
                want.add((d, r["item_id"], c))
    short = {d for d, t in texts.items() if len(t) < 5000}
    got = {(r.doc_id, r.item_id, r.covered) for r in run(spark, "op10_string_tiling").itertuples()}
    assert {x for x in got if x[0] in short} == want and got
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (4, BASE), (4, BASE), (None, BASE), (5, "seven eight")],
                                  "item_id long, text string").withColumn("n", F.lit("clash"))
    pairs = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(hard, bench).collect()}
    assert {(5, 4), (6, 4), (7, 4), (8, 4), (4, 3), (6, 5)} <= pairs and not {p for p in pairs if p[1] in (1, 2, None) or p[0] in (1, 2, 3, None)}
    assert decontaminate.contaminated(none, bench).count() == 0 and decontaminate.contaminated(hard, bench.limit(0)).count() == 0


def test_tiling_finds_reordered_passages(spark):
    w = [f"t{i}" for i in range(30)]
    docs = spark.createDataFrame([(1, " ".join(w[15:] + ["x"] + w[:15]).upper()), (2, " ".join(w[:8] + ["y"] * 30))], "doc_id long, text string")
    got = decontaminate.contaminated(docs, spark.createDataFrame([(9, ", ".join(w))], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["covered"], r["tiles"], r["longest"]) for r in got] == [(1, 30, 2, 15)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=25), st.lists(st.integers(0, 3), max_size=15))
def test_tiles_do_not_overlap(doc, item):
    got = decontaminate.tiles(np.array(doc, np.uint64), np.array(item, np.uint64), 2)
    assert sum(x[2] for x in got) == B.tiling(doc, item, 2)


def test_a_stash_leaves_the_session_setting_as_it_was(spark):
    for before in (None, "false", "true"):
        if before is not None:
            spark.conf.set(common.CLEANUP, before)
        kept = spark.conf.get(common.CLEANUP, None)
        out = common.stash(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count(), "test")
        assert out.count() == 7 and spark.conf.get(common.CLEANUP, None) == kept
    spark.conf.unset(common.CLEANUP)
