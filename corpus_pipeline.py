"""A training corpus from ``documents``: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import discard, materialise
from millrace.llm.mixing import mix_sources
from millrace.llm.packing import pack_documents
from millrace.llm.secret_scan import redact_secrets
from millrace.llm.simhash import drop_near_duplicates
from millrace.llm.toxicity import drop_toxic, fit


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity field rejects go. Null and empty texts stay; of repeated rows all go or all stay."""
    return drop_toxic(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the least id, and of equal ids the first
    by text. Rows with a null id, and texts that are null, empty or without words, stay."""
    return drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked, and ``n_chars`` of such documents is counted anew; every document stays. Null texts stay null."""
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources have their target weights. Null sources are one source; null and
    negative ``n_chars`` count as 0; equal rows are exchangeable. Columns stay as they are."""
    return mix_sources(docs, copy=None)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths, none of which crosses documents. Null and empty texts give none; rows with null or
    repeated ids are packed each on its own."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: Neither the field nor the tokeniser can be said in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written to the shared folder and read again; what the next stage
    has read is removed. An empty table gives an empty one."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
