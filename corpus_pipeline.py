"""From raw documents to packed training batches: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import op4_packing, op5_simhash, op6_langid, op8_mixing, op9_ordinal
from tallyforge.llm.common import shared_dir
from tallyforge.sources.scratch import cleared


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those rejected go."""
    return op6_langid.accepted_documents(docs)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fit on this stage's rated documents, keeps."""
    return op9_ordinal.kept_documents(docs, op9_ordinal.ratings(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return op5_simhash.dedup_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks."""
    return op8_mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their bucket, batch and place in it."""
    return op4_packing.pack_documents(docs)


STAGES = [("language_id", language), ("quality_classifier", classify), ("simhash_dedup", dedup), ("source_mixing", mix), ("packing", pack)]
#: Hashes, compression and a fitted model are beyond SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What each stage returns is written under the shared folder and read again; its operator's own tables go."""
    docs, at = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        with cleared(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs
