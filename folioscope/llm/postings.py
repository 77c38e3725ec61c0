"""Links among the entries of postings of a byte-position index.

An entry is a node with its fingerprint in 64-bit words; a posting is all entries of one key.  Pairs of a posting are tallied
for shared positional bytes, kept from a least number on, and verified by counting differing bits.  Postings are dealt in
cells of about `CELL` entries; a posting of more than `TILE` entries is cut into tiles, and each two tiles are searched in
a task of their own, so no task gathers a long posting.  Each cell gives one link a node at most, which join what all its
links would join: never all pairs of a group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cells, discard, join_counted, materialize, sized

CELL = 100_000
TILE = 8192
#: Longer postings are searched breadth first, shorter ones pair by pair.
SHORT = 48


def shared_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positional bytes that rows a and b (unsigned longs) have in common."""
    return (np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1) == np.ascontiguousarray(b).view(np.uint8).reshape(len(b), -1)).sum(axis=1)


def near(a: np.ndarray, b: np.ndarray, bits: int, least: int) -> np.ndarray:
    """Whether rows a and b share `least` positional bytes and differ in at most `bits` bits."""
    out = np.ones(len(a), dtype=bool) if least <= 0 else shared_bytes(a, b) >= least
    some = np.flatnonzero(out)
    out[some] = np.bitwise_count(a[some] ^ b[some]).sum(axis=1, dtype=np.int64) <= bits
    return out


class Positions:
    """The byte-position index of some rows: who has a byte at a position."""

    def __init__(self, v: np.ndarray):
        self.bytes = np.ascontiguousarray(v).view(np.uint8).reshape(len(v), -1)
        self.order = np.argsort(self.bytes, axis=0, kind="stable")
        self.first = np.stack([np.searchsorted(c[o], np.arange(257)) for c, o in zip(self.bytes.T, self.order.T, strict=True)])

    def tally(self, x: int) -> np.ndarray:
        """Positional bytes that each row shares with row x."""
        lists = [self.order[self.first[p, b] : self.first[p, b + 1], p] for p, b in enumerate(self.bytes[x].astype(np.int64))]
        return np.bincount(np.concatenate(lists), minlength=len(self.bytes))


def forest(v: np.ndarray, bits: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest, breadth first, of the links among rows; each row is verified with those not yet reached only."""
    index = Positions(v) if least > 0 else None
    left = np.ones(len(v), dtype=bool)
    a, b = [], []
    for start in range(len(v)):
        queue = [start] if left[start] else []
        left[start] = False
        while queue:
            x = queue.pop()
            some = np.flatnonzero(left & (index.tally(x) >= least)) if index else np.flatnonzero(left)
            hit = some[np.bitwise_count(v[some] ^ v[x]).sum(axis=1, dtype=np.int64) <= bits]
            left[hit] = False
            a.append(np.full(len(hit), x))
            b.append(hit)
            queue += hit.tolist()
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest of n nodes that each reaches by links a - b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def search_cell(pdf: pd.DataFrame, words: list[str], bits: int, least: int) -> pd.DataFrame:
    """Links among the postings of a cell, at most one a node."""
    order = np.lexsort((pdf["j"].to_numpy(), pdf["i"].to_numpy(), pdf["key"].to_numpy()))
    runs = pdf[["key", "i", "j"]].to_numpy()[order]
    node = pdf["node"].to_numpy()[order]
    v = np.stack([pdf[w].to_numpy()[order] for w in words], axis=1).view(np.uint64)
    new = np.concatenate([[True], (runs[1:] != runs[:-1]).any(axis=1)])
    run, starts = np.cumsum(new) - 1, np.concatenate([np.flatnonzero(new), [len(node)]])
    size = np.diff(starts)[run]
    a, b = [], []
    for k in range(1, int(size[size <= SHORT].max(initial=1))):
        i = np.flatnonzero((run[k:] == run[:-k]) & (size[k:] <= SHORT))
        i = i[near(v[i], v[i + k], bits, least)]
        a.append(i)
        b.append(i + k)
    for s, e in zip(starts[:-1], starts[1:], strict=True):
        if e - s > SHORT:
            x, y = forest(v[s:e], bits, least)
            a.append(x + s)
            b.append(y + s)
    none = np.zeros(0, dtype=np.int64)
    names, which = np.unique(node, return_inverse=True)
    root = roots(which[np.concatenate([none, *a])], which[np.concatenate([none, *b])], len(names))
    linked = np.flatnonzero(root != np.arange(len(names)))
    return pd.DataFrame({"a": names[linked], "b": names[root[linked]]})


def links(entries: DataFrame, words: list[str], bits: int, least: int, nodes: DataFrame | None = None, repeated: bool = False, tile: int = TILE, cell: int = CELL) -> DataFrame:
    """a, b (long): links among the nodes of entries (key long, node long) that join what all links within postings would
    join.  A node's fingerprint is in the columns `words` of entries, or of nodes (node, words), which only entries of
    postings of two nodes or more meet.  repeated: a node may have several entries in a posting."""
    more = [w for w in words if w != "node"]
    counts = entries.groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    many = materialize(counts.select(F.col("key").alias("k"), "m"), "postings-many")
    held = join_counted(entries, many, "key", "k", "m", tile).drop("k")
    if repeated:
        held = held.dropDuplicates(["key", "node"])
    if nodes is not None:
        held = held.join(sized(nodes.select(F.col("node").alias("x"), *more)), F.col("node") == F.col("x")).drop("x")
    held = materialize(held, "postings")
    n = cells(held.sparkSession, held.count(), cell)
    spread = held.withColumn("tiles", F.ceil(F.col("m") / tile).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    spread = spread.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    spread = spread.select("key", "node", *more, F.least("own", "t").cast("long").alias("i"), F.greatest("own", "t").cast("long").alias("j"))
    spread = spread.withColumn("cell", F.pmod(F.xxhash64("key", "i", "j"), F.lit(n)))
    out = materialize(spread.groupBy("cell").applyInPandas(lambda pdf: search_cell(pdf, words, bits, least), "a long, b long"), "postings-links")
    discard(many, held)
    return out
