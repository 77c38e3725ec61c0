"""Packing: lexical retrieval packing.

Documents are dealt to tasks by the least hash among their words of `LONG` characters or more (texts that share words are
likely to share it), so that a document's lexical neighbours tend to lie in its shard; frequent keys are split by size.
A task sorts what it has by that key, cuts it into shards of about `SHARD` bytes of text and indexes each shard by BM25:
postings from every word to the documents that hold it.  A window of `WINDOW` tokens starts from a seed document; the index
returns the seed's nearest unused neighbours, which fill the window greedily, best first.  What is cut off at the end of
a window begins the next one and its document is the next seed, so windows are full; a shard's last, partly filled window
is cut into sequences whose lengths are powers of two, so that nothing is padded.  A shard bounds memory, and a retried
task packs alike: it sorts its rows, and sequence ids hold the partition and a counter.

Defined results: null and empty texts are documents of the end id alone; documents without a neighbour (no shared word)
are followed by the next unused one in order; repeated rows are packed each; null doc_ids are kept; an empty table gives
an empty result.  Only doc_id and text are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stacked, table
from .tokens import default_path, gather, words_and_ids

WINDOW = 2048
SHARD = 6 << 20
LONG = 8
K1, B = 1.2, 0.75


class Index:
    """BM25 over the documents of a shard.  Words of one document are left out: they find no neighbour."""

    def __init__(self, codes: np.ndarray, offsets: np.ndarray):
        n = self.n = len(offsets) - 1
        size = np.diff(offsets)
        doc = np.repeat(np.arange(n), size)
        words = int(codes.max()) + 1 if len(codes) else 1
        pair, tf = np.unique(codes * n + doc, return_counts=True)
        term, d = pair // n, pair % n
        df = np.bincount(term, minlength=words)
        shared = df[term] > 1
        term, d, tf = term[shared], d[shared], tf[shared]
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * size / max(size.mean(), 1)) if n else size
        self.doc = d  # postings, by term
        self.weight = idf[term] * tf * (K1 + 1) / (tf + norm[d])
        self.first = np.searchsorted(term, np.arange(words))
        self.many = np.bincount(term, minlength=words)
        by_doc = np.argsort(d, kind="stable")
        self.terms = term[by_doc]
        self.terms_at = np.concatenate([[0], np.cumsum(np.bincount(d, minlength=n))])

    def scores(self, doc: int) -> np.ndarray:
        terms = self.terms[self.terms_at[doc] : self.terms_at[doc + 1]]
        at = gather(self.first[terms], self.many[terms])
        return np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n)


def pack_shard(lens: np.ndarray, index: Index, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of so many tokens."""
    out: list[tuple[int, int, int, int, int]] = []
    used = np.zeros(len(lens), dtype=bool)
    unused_from, sequence, filled = 0, 0, 0
    scores: np.ndarray | None = None  # of the document that seeds the open window
    total = int(lens.sum())
    left = total
    while left:
        doc = -1
        if scores is not None:
            doc = int(scores.argmax())
            if scores[doc] <= 0:
                doc = -1
        if doc < 0:
            while used[unused_from]:
                unused_from += 1
            doc = unused_from
        used[doc] = True
        if scores is not None:
            scores[doc] = 0
        start, n = 0, int(lens[doc])
        seeds = scores is None
        while n:
            take = min(n, window - filled)
            out.append((doc, start, take, sequence, filled))
            start, n, filled, left = start + take, n - take, filled + take, left - take
            if filled == window:
                sequence, filled, scores, seeds = sequence + 1, 0, None, n > 0
        if seeds and left:
            scores = index.scores(doc)
            scores[used] = 0
    return _in_powers(out, sequence, filled) if filled else out


def _in_powers(out, sequence: int, filled: int):
    """Cut the last window, of `filled` tokens, into sequences of power-of-two lengths."""
    last = [p for p in out if p[3] == sequence]
    out = out[: len(out) - len(last)]
    edges, at = [0], 0
    for bit in range(filled.bit_length() - 1, -1, -1):
        if filled >> bit & 1:
            at += 1 << bit
            edges.append(at)
    for doc, start, n, _, offset in last:
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            lo, hi = max(a, offset), min(b, offset + n)
            if lo < hi:
                out.append((doc, start + lo - offset, hi - lo, sequence + k, lo - a))
    return out


def routed(docs: DataFrame) -> DataFrame:
    """doc_id, text, route: rows of one route lie together, in tasks of like size."""
    words = F.split(F.coalesce("text", F.lit("")), " ")
    least = lambda ws: F.array_min(F.transform(ws, lambda w: F.xxhash64(w)))
    route = F.coalesce(least(F.filter(words, lambda w: F.length(w) >= LONG)), least(words))
    rows = docs.select("doc_id", "text", route.alias("route")).hint("rebalance", F.col("route"))
    return rows.sortWithinPartitions("route", "doc_id", F.xxhash64("text"))


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, shard: int = SHARD, with_ids: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids (unsigned little-endian
    32-bit) of each piece."""
    tokenizer = tokenizer or default_path()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]

    def run(batches):
        base = TaskContext.get().partitionId() << 40
        for b in stacked(batches, 1, shard):
            ids, offsets, codes, word_offsets = words_and_ids(b.column(1), tokenizer)
            ids, lens = ids.astype("<u4"), np.diff(offsets)
            out = np.array(pack_shard(lens, Index(codes, word_offsets), window), dtype=np.int64).reshape(-1, 5)
            a = offsets[out[:, 0]] + out[:, 1]
            spans = list(zip(a.tolist(), out[:, 2].tolist(), strict=True))
            crc = [zlib.crc32(ids[i : i + n]) for i, n in spans]
            cols = [b.column(0).take(pa.array(out[:, 0])), *map(pa.array, (out[:, 1], out[:, 2])), pa.array(crc, pa.int64()), *map(pa.array, (lens[out[:, 0]], base + out[:, 3], out[:, 4]))]
            if with_ids:
                cols.append(pa.array([ids[i : i + n].tobytes() for i, n in spans], pa.binary()))
            base += int(out[:, 3].max()) + 1
            yield pa.RecordBatch.from_arrays(cols, names[: len(cols)])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return routed(docs).mapInArrow(run, schema + ", ids binary" * with_ids)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)
