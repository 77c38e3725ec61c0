"""Embedding near-duplicates: spherical-cap filters.

Filter directions are a product code: after a fixed random rotation a direction is the concatenation of one of B unit
vectors for each half, so B * B directions need 2 * B inner products, and list decoding finds all directions that a
vector exceeds (inner product at least `alpha`) without visiting the others: halves are pruned by the best of the other
half first.  Vectors of one label are joined on the filters they share and verified by cosine in double precision.  B
grows with the square root of the number of vectors, without a cap, so that a filter holds few unrelated ones; alpha
follows B, so that a vector passes about `FILTERS` filters, and is lowered for a vector that would pass fewer than
`LEAST`.  Two vectors at cosine 0.98 then share one with probability above 0.999 at every B (measured in the tests).

Exact copies are one class and are never expanded; a class has a number of its own, whatever ids its vectors carry.  A
filter with more than `TILE` classes is cut into tiles, all pairs of which are compared in tasks of their own.  A pair
that shares several filters is counted at the smallest only; what a filter emits is a sum of links a class and a spanning
forest, so its output is linear in its classes.

Defined results: vectors that are null, empty, zero, hold null or non-finite components, or have no label link with
nothing; vectors of different length never link; rows of one vec_id are vectors of their own with that id, each linked by
its own vector; a row without vec_id links like any other, and a component's id is null only if none of its rows has one;
an empty table gives an empty result.  Only vec_id, embedding and label are read.
"""

from __future__ import annotations

import math
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .components import components

COSINE = 0.98
FILTERS = 48
LEAST = 24
TILE = 2048
#: Below so many dimensions the code has fewer, wider caps.
SMALL = 8
#: Classes that one task compares at a time, counted once for each filter they pass.
CELL = 60_000
_MULT = np.uint64(0x9E3779B97F4A7C15)


def usable(embedding: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(embedding.isNotNull() & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


@lru_cache(maxsize=8)
def code(dim: int, base: int) -> tuple[np.ndarray, list[np.ndarray], float]:
    """Rotation, codewords of the two halves, alpha."""
    rng = np.random.default_rng([dim, base, 11])
    rotation, _ = np.linalg.qr(rng.normal(size=(dim, dim)))
    cuts = [dim - dim // 2, dim // 2]
    words = []
    for c in cuts:
        w = rng.normal(size=(base, max(c, 1)))[:, :c]
        words.append(w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-12) / math.sqrt(2))
    x = rng.normal(size=(64, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    # filters passed at an alpha, counted from the best codewords of each half of some random vectors
    halves = [-np.sort(-y @ w.T, axis=1)[:, :4096] for y, w in zip((x[:, : cuts[0]], x[:, cuts[0] :]), words, strict=True)]
    low, high = 0.0, 2.0
    for _ in range(30):
        alpha = (low + high) / 2
        passed = np.mean([(len(b) - np.searchsorted(b[::-1], alpha - a)).sum() for a, b in zip(*halves, strict=True)])
        low, high = (alpha, high) if passed > FILTERS else (low, alpha)
    if dim < SMALL:  # few directions differ in few dimensions; caps so wide that every vector is well inside one
        words = [np.unique(w.round(9), axis=0)[: 4 ** w.shape[1]] if w.shape[1] else w[:1] for w in words]
        best = (x[:, : cuts[0]] @ words[0].T).max(axis=1) + (x[:, cuts[0] :] @ words[1].T).max(axis=1)
        alpha = 0.7 * float(best.min())
    return rotation, words, alpha


def decode(vectors: np.ndarray, base: int) -> list[np.ndarray]:
    """All filters that each unit vector exceeds."""
    rotation, words, alpha = code(vectors.shape[1], base)
    turned = vectors @ rotation
    cut = words[0].shape[1]
    left, right = turned[:, :cut] @ words[0].T, turned[:, cut:] @ words[1].T
    least = min(LEAST, left.shape[1] * right.shape[1]) if vectors.shape[1] >= SMALL else 0
    out = []
    for a, b in zip(left, right, strict=True):
        at = alpha
        while True:
            i, j = np.flatnonzero(a >= at - b.max()), np.flatnonzero(b >= at - a.max())
            p, q = np.nonzero(a[i][:, None] + b[j] >= at)
            if len(p) >= least:
                break
            at -= 0.01
        out.append(i[p] * base + j[q])
    return out


def _keys(filters: np.ndarray, label: int, dim: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (filters.astype(np.uint64) * _MULT) ^ np.uint64((label * 1_000_003 + dim) & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(29))).view(np.int64)


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that no square overflows or vanishes."""
    x = np.frombuffer(b"".join(raw), dtype=kind).astype(np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def component_kind(vectors: DataFrame) -> str:
    """How components travel: as the table holds them, doubles if they are neither floats nor doubles."""
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    return "<f4" if element == "float" else "<f8"


def digests(vectors: DataFrame, with_raw: bool) -> DataFrame:
    """vec_id, key (a digest of label and components; null for what links with nothing) of each row, and if asked for
    label and raw (the components)."""
    kind = component_kind(vectors)
    ok = usable(F.col("embedding")) & F.col("label").isNotNull()
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), F.when(ok, F.col("embedding")).alias("embedding"))

    def run(batches):
        for b in batches:
            raw = [None if v is None else np.asarray(v, dtype=kind).tobytes() for v in b.column(2).to_pylist()]
            key = [None if r is None else blake2b(r + int(n).to_bytes(16, "little", signed=True), digest_size=16).digest() for r, n in zip(raw, b.column(1).to_pylist(), strict=True)]
            more = [b.column(1), pa.array(raw, pa.binary())] if with_raw else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(key, pa.binary()), *more], ["vec_id", "key", "label", "raw"][: 2 + len(more)])

    return rows.mapInArrow(run, f"vec_id {dict(vectors.dtypes)['vec_id']}, key binary" + ", label long, raw binary" * with_raw)


def classes(vectors: DataFrame) -> DataFrame:
    """rep (a number), key, first (smallest vec_id), n copies, label, raw of each distinct labelled vector."""
    found = digests(vectors, True).where("key is not null").groupBy("key").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("raw").alias("raw"))
    return found.select(F.monotonically_increasing_id().alias("rep"), "key", "first", "n", "label", "raw")


def _same_direction(v: np.ndarray, cosine: float) -> np.ndarray:
    hit = v @ v.T >= cosine
    np.fill_diagonal(hit, False)
    return hit


def _compare(pdf: pd.DataFrame, base: int, cosine: float, kind: str) -> pd.DataFrame:
    """What the filters of one cell show: rows (rep, other, links): links to add to rep's, or a link rep - other."""
    pdf = pdf.sort_values(["dim", "bucket", "i", "j", "side"], kind="stable")
    out_rep, out_other, out_links = [], [], []
    for dim, part in pdf.groupby("dim", sort=True):
        rep, n, key = part["rep"].to_numpy(), part["n"].to_numpy(), part["bucket"].to_numpy()
        side, labels = part["side"].to_numpy(), part["label"].to_numpy()
        vec = _unit(part["raw"].tolist(), kind)
        tile = part["i"].to_numpy() * 1_000_003 + part["j"].to_numpy()
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])])
        starts = np.concatenate([np.flatnonzero(new), [len(key)]])
        run = np.cumsum(new) - 1
        linked = np.diff(starts) > 8  # long runs are compared as matrices; short ones pair by pair first
        for k in range(1, 8):
            same = np.flatnonzero(run[k:] == run[:-k])
            near = same[np.einsum("ij,ij->i", vec[same], vec[same + k]) >= cosine - 1e-9]
            linked[run[near]] = True
        lists: dict[int, np.ndarray] = {}

        def filters(x: int) -> np.ndarray:
            if rep[x] not in lists:
                lists[rep[x]] = np.sort(_keys(decode(vec[x : x + 1], base)[0], int(labels[x]), dim))  # noqa: B023
            return lists[rep[x]]  # noqa: B023

        for r in np.flatnonzero(linked):
            a, b = starts[r], starts[r + 1]
            hit = _same_direction(vec[a:b], cosine)
            if len(np.unique(side[a:b])) > 1:  # two tiles: only pairs across; pairs within have tasks of their own
                hit &= side[a:b, None] != side[None, a:b]
            who = np.flatnonzero(hit.any(axis=1))
            if not len(who):
                continue
            hit = hit[np.ix_(who, who)]
            at = who + a
            lower = [f[: np.searchsorted(f, key[a])] for f in map(filters, at)]
            every, col = np.unique(np.concatenate(lower), return_inverse=True)
            if len(every):
                has = np.zeros((len(at), len(every)), dtype=np.float32)
                has[np.repeat(np.arange(len(at)), [len(x) for x in lower]), col] = 1
                first = hit & (has @ has.T == 0)  # no smaller filter holds both
            else:
                first = hit
            adds = first @ n[at]
            comp = np.arange(len(at))
            while True:
                best = np.minimum(comp, np.where(hit, comp[None, :], len(at)).min(axis=1))
                best = best[best]
                if (best == comp).all():
                    break
                comp = best
            some = np.flatnonzero(adds)
            out_rep += [rep[at[some]], rep[at]]
            out_other += [rep[at[some]], rep[at[comp]]]
            out_links += [adds[some], np.zeros(len(at), dtype=np.int64)]
    if not out_rep:
        return pd.DataFrame({"rep": np.zeros(0, dtype=np.int64), "other": np.zeros(0, dtype=np.int64), "links": np.zeros(0, dtype=np.int64)})
    return pd.DataFrame({"rep": np.concatenate(out_rep), "other": np.concatenate(out_other), "links": np.concatenate(out_links).astype(np.int64)})


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, tile: int = TILE, base: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors."""
    kind = component_kind(vectors)
    width = np.dtype(kind).itemsize
    known = materialize(classes(vectors), "vectors-classes")  # from here on the numbers are fixed
    if base is None:
        base = 1 << max(6, math.ceil(math.log2(max(known.count(), 1)) / 2 + 2))

    def pass_filters(batches):
        for b in batches:
            raw, label = b.column(2).to_pylist(), b.column(1).to_pylist()
            keys = [None] * len(raw)
            by_dim: dict[int, list[int]] = {}
            for k, r in enumerate(raw):
                by_dim.setdefault(len(r) // width, []).append(k)
            some = max(1, min(512, (1 << 22) // base))
            for dim, rows in by_dim.items():
                for c in range(0, len(rows), some):
                    part = rows[c : c + some]
                    for k, f in zip(part, decode(_unit([raw[k] for k in part], kind), base), strict=True):
                        keys[k] = _keys(f, label[k], dim)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.list_(pa.int64()))], ["rep", "buckets"])

    passed = materialize(known.select("rep", "label", "raw").mapInArrow(pass_filters, "rep long, buckets array<long>"), "vectors-filters")
    entries = passed.select("rep", F.explode("buckets").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1").withColumnRenamed("bucket", "b")
    entries = materialize(entries.join(shared, F.col("bucket") == F.col("b")).select("rep", "bucket", "m"), "vectors-shared")
    tiles = F.ceil(F.col("m") / tile).cast("int")
    own = F.pmod(F.xxhash64("rep"), tiles).cast("int")
    spread = entries.withColumn("tiles", tiles).withColumn("own", own).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    spread = spread.select("rep", "bucket", F.least("own", "t").alias("i"), F.greatest("own", "t").alias("j"), F.col("own").alias("side"))
    cells = max(1, math.ceil(entries.count() / CELL))
    full = spread.join(known.select(F.col("rep").alias("k"), "label", "raw", "n"), F.col("rep") == F.col("k")).drop("k")
    full = full.withColumn("dim", (F.length("raw") / width).cast("int")).withColumn("cell", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(cells)))
    seen = materialize(full.groupBy("cell").applyInPandas(lambda pdf: _compare(pdf, base, cosine, kind), "rep long, other long, links long"), "vectors-links")
    sums = seen.where("links > 0").groupBy("rep").agg(F.sum("links").alias("more"))
    comp = components(seen.where("links = 0").select(F.col("rep").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "rep")
    per = known.select("rep", "key", "first", "n").join(sums, "rep", "left").join(comp, "rep", "left").withColumn("root", F.coalesce("component", "rep"))
    # only classes of copies or links can differ from a row of its own
    per = materialize(per.where("n > 1 or component is not null"), "vectors-found")
    least = per.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = per.join(least, "root").select(F.col("key").alias("known"), (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("links"), "component_id")
    out = digests(vectors, False).join(linked, F.col("key") == F.col("known"), "left")
    root = F.when(F.col("known").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), F.col("vec_id").eqNullSafe(root).alias("kept"))


def op2_vector_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
