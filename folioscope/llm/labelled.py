"""A bounded sample of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, discard, materialize


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held_out: int, rows: int, seed: int = 7) -> DataFrame:
    """doc_id, text, label of at most `rows` documents a class, short or long, in the order of a hash of doc_id, never those
    whose crc32(doc_id) mod `mod` is `held_out`.  Of conflicting labels of an id the largest counts, and of several
    texts the one of smallest hash; a null text is empty.  Only ids are looked through, texts are read for the chosen."""
    known = crc_mod(F.col("doc_id"), mod) != held_out
    given = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & known).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    there = materialize(given.join(docs.where(known).select("doc_id"), "doc_id", "left_semi").withColumn("order", F.xxhash64(F.lit(seed), F.col("doc_id"))), "sample-ids")
    first = [there.where(F.col("label") == c).orderBy("order", "doc_id").limit(rows) for c in (0, 1)]
    chosen = materialize(first[0].union(first[1]).select("doc_id", "label"), "sample-chosen")
    discard(there)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.min("label").alias("label"))
