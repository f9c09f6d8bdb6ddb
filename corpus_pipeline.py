"""The corpus pipeline: from documents to token ids, a written table after each stage.

    language  documents in none of the learned languages go
    jaccard   of near-duplicates (five words, similarity 0.8) one stays
    pii       personal data is replaced by its kind
    mix       sources are sampled to their target weights
    encode    each document becomes a sampled segmentation into pieces
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import jaccard_join, language, mixing, pii, sampling
from framelake.llm.common import drop, keep, read


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(spark, docs, language.fit(spark, docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(spark, docs)


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(spark, docs, pii.fit(spark, docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(spark, docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and their scores: a sampled segmentation of each row, of a document's copies another for each.

    Rows without an id are no copies of each other, however many are alike; each takes the first segmentation of its text."""
    named = docs.filter("doc_id is not null").groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
    others = docs.filter("doc_id is null").select("doc_id", "text", F.lit(1).cast("long").alias("copies"))
    return sampling.encode(spark, named.unionByName(others), copies_col="copies")


STAGES = [("language", by_language), ("jaccard", near_duplicates), ("pii", without_pii), ("mix", mixed), ("encode", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    written = None
    for _, stage in STAGES[:-1]:
        docs, before = keep(spark, stage(spark, docs, sf_dir)), written
        if before is not None:
            drop(spark, before)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: Profiles, the field and the sampled segmentations are not SQL; tests hold run() against brute force.
ORACLE_SQL = None
