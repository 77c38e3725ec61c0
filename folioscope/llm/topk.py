"""Exact top-k search by pivot-table elimination.

The table holds, for every row, its distances to the origin and to many pivots: `PIVOT_SHARE` of the dimensions, chosen far
from each other's span.  The distances of a query and a row to the pivots place both in the space that the pivots span and
leave of each only the length of its rest unknown; the largest inner product (the smallest distance) that these allow is
the product of the placed parts plus the product of the lengths of the rests.  No tighter bound follows from the
distances, and it is never weaker than the differences of distances to single pivots, which say next to nothing in tens of
dimensions.  Rows are evaluated in the order of the bound; the search of a block ends when the bound falls below the k-th
best product so far.  Bounds carry a margin for rounding and ties are evaluated, so the result is exact.

Rows travel in blocks of at most `BLOCK`, queries in parts of at most about `QUERIES`; each block meets each part by an
equi-join on the part's number.  Parts are broadcast if all of them are at most `BROADCAST_QUERIES` vectors, else shuffled.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows without vec_id;
rows of other length than a query's are not its candidates; all rows of the query's vec_id are its own; repeated
candidate rows are candidates each; a repeated query is answered once; an empty table gives an empty result; components
are held in longs as casts hold them, products are exact whatever their size, and one beyond a long counts as the nearest
long.  Only vec_id and embedding are read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, table

K = 5
PIVOT_SHARE = 0.75
#: Rows that pivots are chosen from, for each pivot.
PIVOT_CHOICE = 4
BLOCK = 8192
QUERIES = 8192
#: Queries whose bounds are held at a time.
TOGETHER = 128
FIRST = 32
BROADCAST_QUERIES = 65_536


def finite(embedding: Column) -> Column:
    return F.coalesce(embedding.isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def quantized(vectors: DataFrame) -> DataFrame:
    """vec_id, v (floor(256 x) of each component), dim."""
    v = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))
    return vectors.where(finite(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), v.alias("v"), F.size("embedding").alias("dim"))


def _matrix(rows, dim: int) -> np.ndarray:
    return np.array([np.asarray(r, dtype=np.int64) for r in rows], dtype=np.int64).reshape(len(rows), dim)


def _largest(m: np.ndarray) -> float:
    return float(np.abs(m.astype(np.float64)).max(initial=0.0))


class Exact:
    """Exact products of a query with rows: in doubles where every sum is below 2^53, in longs below 2^62, else in
    Python's integers."""

    def __init__(self, queries: np.ndarray, rows: np.ndarray):
        most = _largest(queries) * _largest(rows) * max(rows.shape[1], 1)
        kind = np.float64 if most < 2**53 else np.int64 if most < 2**62 else object
        self.queries, self.rows = queries.astype(kind), rows.astype(kind)

    def __call__(self, query: int, some: np.ndarray) -> np.ndarray:
        if not self.rows.shape[1]:
            return np.zeros(len(some), dtype=np.int64)
        got = self.rows[some] @ self.queries[query]
        if got.dtype == object:
            return np.array([min(max(x, -(2**63)), 2**63 - 1) for x in got.tolist()], dtype=np.int64)
        return got.astype(np.int64)


class Pivots:
    """Chosen rows and what turns distances to them into places."""

    def __init__(self, rows: np.ndarray, dim: int, share: float = PIVOT_SHARE):
        """Each next pivot is the row farthest from the span of those before it."""
        left = rows.astype(np.float64)
        size = np.linalg.norm(left, axis=1) if len(left) else np.zeros(0)
        self.scale = float(size.max(initial=0.0)) or 1.0
        left = left / self.scale
        chosen: list[int] = []
        for _ in range(min(len(rows), math.ceil(share * dim))):
            far = np.einsum("ij,ij->i", left, left)
            at = int(far.argmax())
            if far[at] < 1e-6:
                break
            chosen.append(at)
            axis = left[at] / math.sqrt(far[at])
            left = left - np.outer(left @ axis, axis)
        self.points = rows[chosen].astype(np.float64).reshape(len(chosen), dim) / self.scale
        self.norms = np.einsum("ij,ij->i", self.points, self.points)
        self.place = np.linalg.inv(np.linalg.cholesky(self.points @ self.points.T)).T if chosen else np.zeros((0, 0))

    def distances(self, m: np.ndarray) -> np.ndarray:
        """The table: distances to the origin and to each pivot."""
        f = m.astype(np.float64) / self.scale
        norm = np.einsum("ij,ij->i", f, f)
        gap = norm[:, None] + self.norms[None, :] - 2.0 * (f @ self.points.T)
        return np.sqrt(np.maximum(np.concatenate([norm[:, None], gap], axis=1), 0.0))

    def places(self, distances: np.ndarray) -> np.ndarray:
        """Coordinates in the span of the pivots, and the length of the rest."""
        squares = distances**2
        products = (squares[:, :1] + self.norms[None, :] - squares[:, 1:]) / 2
        at = products @ self.place
        rest = np.sqrt(np.maximum(squares[:, 0] - np.einsum("ij,ij->i", at, at), 0.0))
        return np.concatenate([at, rest[:, None]], axis=1)


def search(query_ids, queries, ids, rows, pivots: Pivots, distances: np.ndarray, k: int = K):
    """Best k rows of a block for each query: query index, row id, product; and how many products were evaluated."""
    product = Exact(queries, rows)
    row_at, query_at = pivots.places(distances), pivots.places(pivots.distances(queries))
    unit = pivots.scale**2
    longest = float(distances[:, 0].max(initial=0.0))
    found_q, found_id, found_s, evaluated = [], [], [], 0
    for a in range(0, len(query_ids), TOGETHER):
        bounds = query_at[a : a + TOGETHER] @ row_at.T  # the rests' lengths are the last coordinate
        for i, bound in enumerate(bounds, a):
            margin = 1e-6 * (longest * float(np.linalg.norm(query_at[i])) + 1e-300)
            some = np.argpartition(-bound, FIRST)[:FIRST] if len(ids) > FIRST else np.arange(len(ids))
            left = None
            best_s, best_i, step = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 2 * FIRST
            while len(some):
                score = product(i, some)
                evaluated += len(some)
                other = ids[some] != query_ids[i]
                best_s, best_i = np.concatenate([best_s, score[other]]), np.concatenate([best_i, ids[some][other]])
                top = np.lexsort((best_i, ~best_s))[:k]  # ~ turns the order round and cannot overflow
                best_s, best_i = best_s[top], best_i[top]
                least = float(best_s[-1]) / unit - margin if len(best_s) == k and best_s[-1] > -(2**63) else -math.inf
                if left is None:
                    bound[some] = -math.inf
                    left = np.flatnonzero(bound >= max(least, -1e300))
                    left = left[np.argsort(-bound[left], kind="stable")]
                left = left[: int(np.searchsorted(-bound[left], -least, side="right"))]
                some, left, step = left[:step], left[step:], step * 2
            found_q.append(np.full(len(best_i), i))
            found_id.append(best_i)
            found_s.append(best_s)
    none = np.zeros(0, dtype=np.int64)
    return *(np.concatenate([none, *x]) for x in (found_q, found_id, found_s)), evaluated


def top_k(queries: DataFrame, vectors: DataFrame, k: int = K, pivot_share: float = PIVOT_SHARE, block: int = BLOCK, most_queries: int = QUERIES, broadcast: int = BROADCAST_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of vectors with the largest product for each of queries."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    rows = quantized(vectors)
    asked = materialize(quantized(queries).distinct(), "topk-queries")
    results = []
    for dim, n in [(r["dim"], r["count"]) for r in asked.groupBy("dim").count().collect()]:  # one turn a vector length
        of_dim = rows.where(F.col("dim") == dim).drop("dim")
        sample = of_dim.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_CHOICE * math.ceil(pivot_share * dim)).collect()
        pivots = Pivots(_matrix([r["v"] for r in sample], dim), dim, pivot_share)

        def pack(frames, dim=dim, pivots=pivots):
            def block_of(held):
                pdf = pd.concat(held, ignore_index=True)
                m = _matrix(pdf["v"].tolist(), dim)
                return pd.DataFrame({"ids": [pdf["vec_id"].to_numpy(dtype=np.int64).tobytes()], "rows": [m.tobytes()], "dist": [pivots.distances(m).tobytes()]})

            held: list[pd.DataFrame] = []
            many = 0
            for f in frames:
                at = 0
                while at < len(f):
                    some = f.iloc[at : at + block - many]
                    held.append(some)
                    at, many = at + len(some), many + len(some)
                    if many == block:
                        yield block_of(held)
                        held, many = [], 0
            if held:
                yield block_of(held)

        blocks = materialize(of_dim.mapInPandas(pack, "ids binary, rows binary, dist binary"), "topk-blocks")
        parts = max(1, math.ceil(n / most_queries))
        keyed = asked.where(F.col("dim") == dim).withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts)).cast("int"))

        def bundle(pdf: pd.DataFrame, *, dim=dim) -> pd.DataFrame:
            return pd.DataFrame({"part": [pdf["part"].iloc[0]], "q_ids": [pdf["vec_id"].to_numpy(dtype=np.int64).tobytes()], "q_rows": [_matrix(pdf["v"].tolist(), dim).tobytes()]})

        bundles = materialize(keyed.groupBy("part").applyInPandas(bundle, "part int, q_ids binary, q_rows binary"), "topk-bundles")

        def compare(frames, dim=dim, pivots=pivots):
            for f in frames:
                for part, q_ids, q_rows, ids, rows_, dist in zip(f["part"], f["q_ids"], f["q_rows"], f["ids"], f["rows"], f["dist"], strict=True):
                    qi, ri = np.frombuffer(q_ids, dtype=np.int64), np.frombuffer(ids, dtype=np.int64)
                    q, r = np.frombuffer(q_rows, dtype=np.int64).reshape(len(qi), dim), np.frombuffer(rows_, dtype=np.int64).reshape(len(ri), dim)
                    i, found, score, _ = search(qi, q, ri, r, pivots, np.frombuffer(dist).reshape(len(ri), -1), k)
                    yield pd.DataFrame({"query_id": qi[i], "part": part, "part_row": i, "vec_id": found, "score": score})

        dealt = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        grid = dealt.join(F.broadcast(bundles) if n <= broadcast else bundles, "part")
        results.append(grid.mapInPandas(compare, "query_id long, part int, part_row long, vec_id long, score long").withColumn("dim", F.lit(dim)))
    if not results:
        return spark.createDataFrame([], schema)
    every = results[0]
    for r in results[1:]:
        every = every.unionByName(r)
    order = W.partitionBy("query_id", "dim", "part", "part_row").orderBy(F.col("score").desc(), "vec_id")
    ranked = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors)


OP5_SQL = """
WITH ok AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
  FROM (SELECT * FROM ok WHERE vec_id % 50 = 0) q JOIN ok c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""
