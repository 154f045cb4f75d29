"""The pipeline's stages, one by one, against brute force on the smallest tables."""

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline as P
from ladderkit.llm.common import stash, table
from tests.conftest import SF001
from tests.llm import brute as B


def test_stages(spark):
    docs = table(spark, SF001, "documents")
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF001, "labels").collect()}
    items = [B.plain_words(r["text"]) for r in table(spark, SF001, "benchmark").collect()]
    assert [n for n, _ in P.STAGES] == ["quality", "line_dedup", "ngram_jaccard", "decontamination", "packing"]
    for name, stage in P.STAGES[:-1]:
        out = stash(stage(spark, docs, SF001), "test")
        assert out.columns == docs.columns
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "quality":
            wrong = [i for i in before if i in labels and (i in after) != bool(labels[i])]
            assert set(after) <= set(before) and len(wrong) <= 2
        elif name == "line_dedup":
            want = {i: t for i, t, gone in B.dedup_lines(list(before.items())) if not gone or t.strip(" \t\r\n")}
            assert after == want
        elif name == "ngram_jaccard":
            comp = B.components(list(before.items()))
            assert set(after) == {i for i, c in comp.items() if i == c}
        else:
            for i, t in before.items():
                words = B.plain_words(t)
                text = " ".join(words)
                held = any(" ".join(w) in text for w in items)
                assert not (held and i in after)
                if i not in after:
                    assert max(B.tiling(words, w, 5) / len(w) for w in items if set(w) & set(words)) >= 0.5
        docs = out
    got = P.pack_windows(spark, docs, SF001).toPandas()
    path = public_tokenizers.path("word_bpe_49k.json")
    for r in docs.collect():
        assert got[got.doc_id == r["doc_id"]].length.sum() == len(B.token_ids(path, r["text"]))


def test_empty_documents(spark):
    docs = table(spark, SF001, "documents").limit(0)
    for _, stage in P.STAGES:
        docs = stash(stage(spark, docs, SF001), "test")
        assert docs.count() == 0
        if "text" not in docs.columns:
            break


def test_decontamination_tells_rows_of_null_and_equal_ids_apart(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").filter("text is not null").orderBy("doc_id").limit(40)
    item = spark.read.parquet(f"{SF001}/benchmark.parquet").orderBy(F.length("text").desc()).first()["text"]
    clean = P.drop_contaminated(spark, docs, SF001).checkpoint()
    dirty = clean.limit(1).withColumn("text", F.lit(item))   # has the id of a clean document
    nameless = dirty.withColumn("doc_id", F.lit(None).cast("long"))
    out = P.drop_contaminated(spark, clean.unionByName(dirty).unionByName(nameless), SF001)
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in clean.collect())


def test_few_decisions_meet_texts_without_a_shuffle(spark, monkeypatch):
    docs = spark.range(2000).selectExpr("id as doc_id", "concat('text ', id) as text")
    pairs = spark.range(2000).selectExpr("id as doc_id", "if(id % 500 = 3, 0, id) as component_id")
    monkeypatch.setattr(P.jaccard, "linked_components", lambda d: pairs)
    monkeypatch.setattr(P.decontaminate, "contaminated", lambda d, b: d.filter("text in ('text 7', 'text 9')"))
    monkeypatch.setattr(P, "table", lambda *a: None)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # as when the decisions' file is large
    try:
        for stage, n in ((P.one_of_each_group, 1996), (P.drop_contaminated, 1998)):
            out = stage(spark, docs, "")
            assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
            assert out.count() == n
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
