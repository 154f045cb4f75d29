"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontaminate, jaccard, language, lines, packing, pii, quality, repair, sharding, spelling, topk, toxicity,
               whitening)
from .common import crc_mod, stash, table

TOP_K = 10


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    names, probs = language.fit(docs.filter(~held_out))
    return language.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), names, probs, ["doc_id", "held_out"])


def op2_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "removed", "text")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantise(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding")
    return topk.topk(vectors.filter(F.col("vec_id") % 100 == 0), vectors, TOP_K)


def scored_documents(docs: DataFrame, labels: DataFrame, train, keep: list[str]) -> DataFrame:
    """``keep`` columns and the quality score of every document, the model fitted on the labelled
    documents for which ``train`` holds; the statistics are written once and read for both."""
    stats = stash(quality.add_statistics(docs.withColumn("__key", F.col("doc_id")), [*keep, "__key"]), "stats")
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("__key"), F.col("quality").alias("label"))
    model = quality.fit(stats.filter(train(F.col("__key"))).select("__key", "stats").join(known, "__key"))
    return quality.add_score(stats, model, keep)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    scored = scored_documents(docs.select("doc_id", held_out.alias("held_out"), "text"), table(spark, sf_dir, "labels"),
                              lambda key: crc_mod(key, 4) != 2, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op7_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = stash(repair.encode_table(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")), "repair")
    return repair.read_documents(written).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked_components(table(spark, sf_dir, "documents"))


def op10_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(crc_mod(F.col("doc_id"), 4) != 2)
    model = toxicity.fit(docs, labels.select("doc_id", F.col("toxic").alias("label")))
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    scored = toxicity.add_score(docs.select("doc_id", held_out.alias("held_out"), "text"), model, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.count_words(table(spark, sf_dir, "documents")))


SQL = {
    "op5_exact_topk": f"""
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e
          FROM embeddings
          WHERE embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s)
        SELECT query_id, rn::INTEGER AS "rank", vec_id, score FROM r WHERE rn <= {TOP_K}""",
}


def queries() -> dict:
    fns = [op1_language_mixture, op2_pii_disclosure, op3_line_dedup, op4_packing, op5_exact_topk,
           op6_quality_classifier, op7_repair_tokens, op8_sharding, op9_ngram_jaccard, op10_string_tiling,
           op11_embedding_whitening, op12_toxicity, op13_spelling_variants]
    return {f.__name__: f for f in fns}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
