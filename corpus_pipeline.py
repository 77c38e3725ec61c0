"""From raw documents to packed training sequences.

Stages, each given what the one before kept: quality classifier (rejected documents go), toxicity (rejected documents
go), near copies (one document of each group stays), mixing (documents repeated or left out to meet source targets), and
packing (the pieces of 2048-token sequences).  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import mixing, packing, quality, simhash, simhash_wide, toxicity
from folioscope.llm.common import materialize, table
from folioscope.session import ship


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.classify(docs, table(spark, sf_dir, "labels"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.drop_near_copies(docs, simhash_wide.exact_groups, simhash_wide.fingerprint)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs, with_ids=False)


STAGES = [
    ("quality classifier", keep_good),
    ("toxicity", keep_clean),
    ("simhash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("packing", pack),
]

#: SQL can express neither the learned stages nor the packing; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{i}")
    return docs
