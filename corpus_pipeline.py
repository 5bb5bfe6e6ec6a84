"""Pipeline over ``documents``: classifier, quality rules, near-duplicates, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace import session
from millrace.llm import decontaminate, jaccard, packing, quality_fm, rules
from millrace.llm.common import documents, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = quality_fm.train(docs, session.table(spark, sf_dir, "labels"))
    return quality_fm.score(docs, model, carry=docs.columns).where("predicted = 1").select("doc.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules keep."""
    return rules.judge(docs, carry=docs.columns).where("kept").select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    found = decontaminate.contamination(docs, session.table(spark, sf_dir, "benchmark"), carry=docs.columns)
    return found.where("not contaminated").select("doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their ids (little-endian unsigned 32-bit)."""
    return packing.pack(docs).select("doc.doc_id", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                                     "offset", "tier", "step_group")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Models, EM and tokenizers have no counterpart in SQL; tests compare the stages with brute force.
ORACLE_SQL = None
