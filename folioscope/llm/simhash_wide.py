"""Near-duplicates by similarity: shingle sets of five words with Jaccard similarity `SIMILARITY` or more.

Four bits-by-majority words of 64 bits each stand for a text's set of shingles.  Two sets of Jaccard similarity J differ in
about acos(2J / (1 + J)) / pi of the bits.  Candidates come from two inverted indexes over distinct fingerprints, both
searched as postings.py says:

- Byte positions: two byte values at positions of one class (classes of 3, 3 and 2 positions a word: 28 postings); pairs
  of a posting are tallied for shared positional bytes, kept from `SHARED` on, at `most_bits` differing bits or fewer.  No
  number of shared bytes is certain at that distance, so this index alone loses pairs.
- Shingles, which lose none: of n shingles, the n - ceil(0.8 n) + 1 of smallest hash are posted; two sets that share no
  posting have similarity below 0.8.  Pairs of a posting go on at `filter_bits` differing bits or fewer, eight standard
  deviations above what similarity 0.8 gives.

Candidates form clusters.  Each cluster's shingle sets are compared exactly (64-bit hashes of shingles), and only pairs at
the similarity link.  A cluster whose sets hold more than `TILE` bytes is cut into tiles, and each two tiles are compared
apart.  The contract's exact operator at four bits is in simhash.py.

Defined results: as in simhash.py; texts without words are copies of each other; texts of fewer words than a shingle are
one shingle.  Fingerprints travel as their 64-bit hash: two of them that collide would count as copies (odds of 1 in
30,000 for 30 million texts).
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import postings
from .common import cells, discard, materialize, pieces, sized
from .components import components
from .simhash import BROADCAST_IDS, named_groups, shingle_hashes
from .subwords import mix64

WIDTH = 5
SIMILARITY = 0.8
WORDS = 4
SHARED = 4
SEED = 7
#: Bytes of a cluster's sets that are compared at a time, and of the sets of a cell of clusters.
TILE, CELL = 1 << 20, 4 << 20
CLASSES = ((0, 1, 2), (3, 4, 5), (6, 7))
PAIRS = [(8 * w + a, 8 * w + b) for w in range(WORDS) for c in CLASSES for a, b in combinations(c, 2)]
COLUMNS = [f"w{k}" for k in range(WORDS)]
_SALT = np.array([0x9E3779B97F4A7C15 * (k + 1) % 2**64 for k in range(WORDS)], dtype=np.uint64)


def most_bits(similarity: float = SIMILARITY, deviations: float = 0.5) -> int:
    """Differing bits that texts of a similarity have on average, and so many standard deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    n = 64 * WORDS
    return round(n * p + math.sqrt(n * p * (1 - p)) * deviations)


def filter_bits(similarity: float = SIMILARITY) -> int:
    """Differing bits that no two texts of a similarity are expected to pass."""
    return most_bits(similarity, 8)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Hashes of a text's distinct shingles, ascending."""
    return np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *shingle_hashes(text, width, SEED)]))


def majority(h: np.ndarray) -> np.ndarray:
    """The fingerprint of a set of shingles: WORDS unsigned longs."""
    counts = np.zeros(64 * WORDS, dtype=np.int64)
    for at in range(0, len(h), 1 << 13):
        wide = mix64(h[at : at + (1 << 13), None] * np.uint64(0xD6E8FEB86659FD93) + _SALT[None, :])
        counts += np.unpackbits(wide.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(h)).view(np.uint64)


def number(fingerprint: np.ndarray) -> int:
    """The fingerprint's hash, as a signed long."""
    h = xxhash.xxh64_intdigest(fingerprint.tobytes())
    return h - (1 << 64) if h >= 1 << 63 else h


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    return number(majority(shingles(text, width)))


def prefix(h: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The shingles to post: a set at the similarity or above shares one of them."""
    n = len(h)
    return h[: n - math.ceil(similarity * n - 1e-9) + 1]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *[x.view(np.int64) for x in arrays]])))


def prints(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """doc_id, fp (the fingerprint's number), its words, and low (the shingles to post) of each row."""

    def run(batches):
        for x in (piece for batch in batches for piece in pieces(batch, 1, 2 << 20)):
            sets = [shingles(t.as_py(), width) for t in x.column(1)]
            found = [majority(h) for h in sets]
            words = np.stack(found).view(np.int64)
            low = _lists([prefix(h, similarity) for h in sets])
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array([number(f) for f in found], pa.int64()), *[pa.array(words[:, k]) for k in range(WORDS)], low], ["doc_id", "fp", *COLUMNS, "low"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long, {', '.join(f'{w} long' for w in COLUMNS)}, low array<long>")


def estimated_links(nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """a, b: links by differing bits between fingerprints that meet in the byte-position index.  nodes: fp, words."""
    byte = lambda p: F.shiftrightunsigned(F.col(COLUMNS[p // 8]), 8 * (p % 8)).bitwiseAND(F.lit(255))
    keys = [F.lit(i << 16).cast("long").bitwiseOR(F.shiftleft(byte(p), 8)).bitwiseOR(byte(q)) for i, (p, q) in enumerate(PAIRS)]
    entries = nodes.select(F.explode(F.array(*keys)).alias("key"), F.col("fp").alias("node"), *COLUMNS)
    return postings.links(entries, COLUMNS, most_bits(similarity), SHARED)


def shingle_links(fps: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """a, b: links by differing bits between fingerprints that share a posted shingle."""
    entries = fps.select(F.explode("low").alias("key"), F.col("fp").alias("node"))
    return postings.links(entries, COLUMNS, filter_bits(similarity), 0, nodes.withColumnRenamed("fp", "node"), repeated=True)


def _similar(sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Spanning forest of the sets at a Jaccard similarity or above, breadth first."""
    size = np.array([len(x) for x in sets])
    left = np.ones(len(sets), dtype=bool)
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(size)])
    doc, of, a, b = np.repeat(np.arange(len(sets)), size), code, [], []
    for first in range(len(sets)):
        queue = [first] if left[first] else []
        left[first] = False
        while queue and left.any():
            x = queue.pop()
            mine = np.zeros(len(values), dtype=bool)
            mine[code[at[x] : at[x + 1]]] = True
            both = np.bincount(doc[mine[of]], minlength=len(sets))
            found = np.flatnonzero(left & (both * (1 + similarity) >= similarity * (size[x] + size) - 1e-9)).tolist()
            if found:
                a += [x] * len(found)
                b += found
                queue += found
                left[found] = False
                stay = left[doc]
                doc, of = doc[stay], of[stay]
    return a, b


def _verify(pdf: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Links of the clusters, or two tiles of one, in a cell."""
    a, b = [], []
    for _, rows in pdf.groupby(["cluster", "i", "j"], sort=False):
        name = rows["fp"].tolist()
        x, y = _similar([np.frombuffer(r, dtype=np.uint64) for r in rows["shingles"]], similarity)
        a += [name[k] for k in x]
        b += [name[k] for k in y]
    return pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})


def _sets(docs: DataFrame, nodes: DataFrame, clusters: DataFrame, width: int) -> DataFrame:
    """fp, cluster, shingles of the fingerprints in clusters, from one row of each."""

    def run(batches):
        for x in (piece for batch in batches for piece in pieces(batch, 0, 1 << 20)):
            sets = [shingles(t.as_py(), width) for t in x.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([number(majority(h)) for h in sets], pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary())], ["own", "shingles"])

    ids = materialize(nodes.join(sized(clusters), "fp").select(F.col("first").alias("some_id")).distinct(), "wide-ids")
    rows = docs.join(sized(ids, BROADCAST_IDS), docs["doc_id"].eqNullSafe(ids["some_id"]), "left_semi")
    sets = rows.select("text").mapInArrow(run, "own long, shingles binary")
    return sized(clusters).join(sets, F.col("fp") == F.col("own")).groupBy("fp", "cluster").agg(F.first("shingles").alias("shingles"))


def exact_links(docs: DataFrame, fps: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """a, b: links between distinct fingerprints that join what all pairs at the Jaccard similarity join."""
    words = nodes.select("fp", *COLUMNS)
    near = components(estimated_links(words, similarity).union(shingle_links(fps, words, similarity)))
    clusters = materialize(near.select(F.col("node").alias("fp"), F.col("component").alias("cluster")), "wide-clusters")
    sets = materialize(_sets(docs, nodes, clusters, width), "wide-sets")
    size = F.length("shingles")
    tiles = sets.groupBy("cluster").agg(F.ceil(F.sum(size) / TILE).cast("int").alias("tiles")).select(F.col("cluster").alias("c"), F.greatest("tiles", F.lit(1)).alias("tiles"))
    own = sets.join(tiles, F.col("cluster") == F.col("c")).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    spread = own.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    spread = spread.select("cluster", "fp", "shingles", F.least("own", "t").alias("i"), F.greatest("own", "t").alias("j"))
    total = own.agg(F.sum(size * F.col("tiles"))).first()[0] or 0
    spread = spread.withColumn("cell", F.pmod(F.xxhash64("cluster", "i", "j"), F.lit(cells(docs.sparkSession, total, CELL))))
    out = materialize(spread.groupBy("cell").applyInPandas(lambda pdf: _verify(pdf, similarity), "a long, b long"), "wide-links")
    discard(clusters, sets)
    return out


def exact_groups(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """doc_id, fp, component_id and root (the fingerprint that names the group) of each row."""
    fps = materialize(prints(docs, similarity, width), "wide-fp")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), *[F.first(w).alias(w) for w in COLUMNS])
    nodes = materialize(nodes, "wide-nodes")
    return named_groups(fps.select("doc_id", "fp"), nodes, exact_links(docs, fps, nodes, similarity, width))
