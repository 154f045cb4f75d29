"""Corpus pipeline: quality, line dedup, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read as the next
stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderkit.llm import decontaminate, jaccard, lines, packing, quality
from ladderkit.llm.common import small, stash, table
from ladderkit.llm.queries import scored_documents


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on all labelled ones, accepts."""
    names = docs.columns
    scored = scored_documents(docs, table(spark, sf_dir, "labels"), lambda key: F.lit(True), [*names])
    return scored.filter(F.col("score") >= quality.THRESHOLD).select(*names)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; a document that loses all its words that way goes."""
    names = docs.columns
    out = lines.dedup_lines(docs.withColumn("n_chars", F.col("n_chars")))
    worded = F.col("text").rlike(r"[^ \t\r\n]")
    return (out.filter((F.col("n_removed") == 0) | worded)
            .withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
            .select(*names))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near duplicates; rows without an id stay."""
    groups = stash(jaccard.linked_components(docs), "groups")
    gone = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(small(gone, gone.count()), "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows are told apart by a hash of id and text, so ids may be null or equal."""
    key = F.xxhash64("doc_id", "text")
    found = decontaminate.contaminated(docs.withColumn("doc_id", key), table(spark, sf_dir, "benchmark"))
    gone = stash(found.select(F.col("doc_id").alias("__key")).distinct(), "contaminated")
    return docs.join(small(gone, gone.count()), key == F.col("__key"), "left_anti").select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", one_of_each_group),
    ("decontamination", drop_contaminated),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokenizing and the quadratic discriminant are beyond SQL; run() is tested against brute force.
ORACLE_SQL = None
