"""Mixing sources to target weights, with DataFrame functions only.

Every source gets a weight; a token budget (a share of all tokens) is dealt to the sources in proportion to the weights,
no source above ``max_rate`` times its own tokens, the excess dealt again by weight.  A source's repetition rate is its
target over its tokens; a document is emitted floor(rate) times, and once more with the fraction as probability.  The
draw compares a hash of (seed, doc_id) with the fraction, so reruns, retries and other partitionings agree.

Defined results: null text has size 0; a null source is a source of its own, last in order; a null doc_id draws as the
empty text; repeated rows draw alike; sources without tokens have target 0 and are taken 0 times; an empty table gives
an empty result; further columns pass through `mix` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, materialize, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_RATE = 2.0
SEED = "mix-1"
#: Source tables of at most so many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_SOURCES = 50_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the first 52 bits of md5(seed:doc_id)."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, max_rate=MAX_RATE) -> DataFrame:
    """source, source_size, target from rows (source, size).

    Dealing the excess again until no source is above its cap has a closed form: with sources in order of
    cap / weight, the capped ones are a prefix, and the rest share what is left by weight.  The windows run over one row
    a source, never over documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(by_name) - 1) % len(weights)
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (k + 1).cast("int")))
    per = per.withColumn("cap", F.lit(float(max_rate)) * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rest = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    every = W.partitionBy()
    budget = F.lit(float(share)) * F.sum("source_size").over(every)
    # level if this source and all after it shared what the capped ones before it leave
    per = per.withColumn("level", (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    per = per.withColumn("is_capped", F.col("cap") <= F.col("level") * F.col("w"))
    per = per.withColumn("free_level", F.min(F.when(~F.col("is_capped"), F.struct(F.col("cap") / F.col("w"), "level"))).over(every)["level"])
    target = F.when(F.col("is_capped") | F.col("free_level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("free_level") * F.col("w")))
    return per.select("source", F.col("source_size").cast("long"), target.cast("double").alias("target"))


def plan(docs: DataFrame, weights=WEIGHTS, share=SHARE, max_rate=MAX_RATE, seed=SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies for each row of docs."""
    sizes = materialize(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")), "mix-sizes")  # texts are counted once
    per = materialize(targets(sizes, weights, share, max_rate), "mix-sources")
    small = per.count() <= BROADCAST_SOURCES
    right = per.withColumnRenamed("source", "mix_source")
    out = sizes.join(F.broadcast(right) if small else right, F.col("source").eqNullSafe(F.col("mix_source")), "left").drop("mix_source")
    return out.withColumn("rate", _rate(max_rate)).withColumn("copies", _copies(seed)).select("doc_id", "source", "size", "source_size", "target", "rate", "copies")


def _rate(max_rate: float) -> Column:
    return F.when(F.col("source_size") > 0, F.least(F.lit(float(max_rate)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))


def _copies(seed: str) -> Column:
    whole = F.floor("rate")
    return (whole + F.when(uniform(F.col("doc_id"), seed) < F.col("rate") - whole, 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, max_rate=MAX_RATE, seed=SEED) -> DataFrame:
    """The mixed documents themselves, each row repeated as often as the mix takes it, with the columns of docs."""
    cols = docs.columns
    kept = docs.select(F.struct(*[docs[c] for c in cols]).alias("row"))
    sizes = kept.select(F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), size_of(F.col("row.text")).alias("size"))
    per = materialize(targets(sizes, weights, share, max_rate), "mix-sources")
    small = per.count() <= BROADCAST_SOURCES
    right = per.withColumnRenamed("source", "mix_source")
    out = kept.join(F.broadcast(right) if small else right, F.col("row.source").eqNullSafe(F.col("mix_source")), "left")
    out = out.withColumn("doc_id", F.col("row.doc_id")).withColumn("rate", _rate(max_rate)).withColumn("copies", _copies(seed))
    out = out.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select("row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plan(table(spark, sf_dir, "documents"))
    return p.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP4_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS s FROM sizes GROUP BY source
), ranked AS (
  SELECT *, 2.0 * s AS cap, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS w FROM per
), levels AS (
  SELECT *, (1.5 * sum(s) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked WINDOW o AS (ORDER BY cap / w, source NULLS LAST)
), free AS (
  SELECT min_by(level, cap / w) AS free_level FROM levels WHERE cap > level * w
), t AS (
  SELECT source, CAST(s AS BIGINT) AS source_size,
         CASE WHEN cap <= level * w OR free_level IS NULL THEN cap ELSE least(cap, free_level * w) END AS target
  FROM levels, free
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN least(2.0, t.target / t.source_size) ELSE 0.0 END AS rate,
         CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u
  FROM sizes d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
