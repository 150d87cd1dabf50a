"""Corpus pipeline: documents go through the stages in order; each stage's rows are written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last give the columns of
documents.

Defined results: null and empty texts are not toxic, stay unless they are equal ids' copies (a text without words is
linked with nothing), match no benchmark item, take no words of the mixture and so leave it; of equal texts the smallest
id stays; rows repeated under one id stay or go together; an empty table gives no rows; other columns are kept as they are
up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pluvion.llm import common, decontaminate, mixing, near_dup, tokens, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model does not find toxic."""
    return toxicity.accepted(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more."""
    return near_dup.kept(docs, k=5, num=80, den=100)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixture: for each of its documents the place, number and checksum of its ids, read back."""
    return tokens.token_digest(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", near_dedup),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: Model fitting and connected components are not SQL; test_pipeline in tests/llm/test_models.py holds each stage's rows against
#: brute force, and test_stages_on_odd_and_empty_tables runs them on nulls, empty texts, ties, repeats and no rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
