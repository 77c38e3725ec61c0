"""LM scoring: deleted interpolation of n-gram models of orders 2, 1 and 0.

P(w | h) = l2(b) c(h w) / c(h) + l1(b) c(w) / N + l0(b) / (V + 1), where b is the bucket of c(h), the context's count, by
powers of two.  The weights l are learned by expectation-maximisation on deleted counts: every training token is held out
of its own counts in turn, so each (c(h w) - 1, c(h) - 1, c(w) - 1) is an event of a document that the model did not see.

Counting without gathering any key: documents become chunks of about `CHUNK` bytes of text (one row each, words replaced
by local codes).  A chunk asks for the totals of its distinct words and word pairs by 64-bit hash; keys are dealt by
their own hash, so no frequent word or context makes a task large; a bucket sums what all chunks state and answers each
chunk in the order it asked.  Keys travel as sorted differences in byte planes, compressed.  With the answers a chunk
has all counts of its tokens.  Nothing is sampled or capped; what the driver learns is N, V and a histogram of deleted
probabilities a bucket, rounded to powers of 2^(1/4), whose size does not grow with the corpus.

Defined results: null text is empty and has the end token alone; without training documents every probability is 1;
a null doc_id counts as the empty text for the split; repeated rows count and score each; an empty table gives an empty
result.  Words whose 64-bit hashes collide would share counts (odds of 1 in 10^6 for five million distinct keys).
Only doc_id and text are read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, encode_words, materialize, segment_sums, table

MOD, HELD_OUT = 7, 2
CHUNK = 4 << 20
#: Keys that a bucket should hold at most.
BUCKET_KEYS = 1_000_000
LEVELS = 41
STEP = 4  # histogram cells a factor of two
_MULT = np.uint64(0x9E3779B97F4A7C15)
_END = np.uint64(xxhash.xxh64_intdigest(b" end"))  # no word holds white space
_START = np.uint64(xxhash.xxh64_intdigest(b" start"))


def _squeeze(a: np.ndarray) -> bytes:
    """An integer array as compressed byte planes."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b"")


def _widen(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 31), dtype=np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()


def _chunks(batches):
    """doc_ids, per-document word counts and training flags, words as codes, and the hash of each code, of each chunk."""
    part, seq = TaskContext.get().partitionId(), 0
    held, size = [], 0

    def row(held, seq):
        ids, text, train = (pa.concat_arrays([h.column(k) for h in held]) for k in range(3))
        words, codes, offsets = encode_words(text)
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in words.cast(pa.large_binary()).to_pylist()], dtype=np.uint64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([(part << 24) + seq], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                pa.array([_squeeze(np.diff(offsets).astype(np.uint32))], pa.binary()),
                pa.array([_squeeze(np.asarray(train).astype(np.uint8))], pa.binary()),
                pa.array([_squeeze(codes.astype(np.uint32))], pa.binary()),
                pa.array([_squeeze(hashes)], pa.binary()),
            ],
            ["chunk", "doc_ids", "lens", "train", "codes", "hashes"],
        )

    for batch in batches:
        at = 0
        lens = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0)).astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(lens)])
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(upto, upto[at] + CHUNK - size, side="right")) - 1)
            held.append(batch.slice(at, stop - at))
            size += int(upto[stop] - upto[at])
            at = stop
            if size >= CHUNK or at < batch.num_rows:
                yield row(held, seq)
                held, size, seq = [], 0, seq + 1
    if held:
        yield row(held, seq)


class Chunk:
    """Tokens of a chunk: words by code, then the end of each document (code n_words); contexts may be the start."""

    def __init__(self, lens: bytes, train: bytes, codes: bytes, hashes: bytes):
        words = _widen(lens, np.uint32).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(words)])
        hashed = _widen(hashes, np.uint64)
        end, start = len(hashed), len(hashed) + 1
        self.end, self.start = end, start
        self.codes = np.insert(_widen(codes, np.uint32).astype(np.int64), offsets[1:], end)
        self.offsets = offsets + np.arange(len(offsets))
        self.context = np.empty_like(self.codes)
        self.context[1:] = self.codes[:-1]
        self.context[self.offsets[:-1]] = start
        self.train = _widen(train, np.uint8).astype(bool)
        self.train_token = np.repeat(self.train, words + 1)
        pairs, self.pair = np.unique(self.context * (end + 2) + self.codes, return_inverse=True)
        h = np.concatenate([hashed, np.array([_END, _START], dtype=np.uint64)])
        keys = (h[pairs // (end + 2)] * _MULT + (h[pairs % (end + 2)] ^ (h[pairs % (end + 2)] >> np.uint64(32)))) * np.uint64(0xD6E8FEB86659FD93)
        keys ^= keys >> np.uint64(32)
        self.keys = [h[:-1], keys]  # of words and the end; of pairs
        self.order = [np.argsort(k, kind="stable") for k in self.keys]

    def counts(self) -> list[np.ndarray]:
        return [np.bincount(x[self.train_token], minlength=len(k)) for x, k in zip((self.codes, self.pair), self.keys, strict=True)]


def _requests(bits: int):
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                c = Chunk(r["lens"], r["train"], r["codes"], r["hashes"])
                rows = []
                for kind, (keys, order, n) in enumerate(zip(c.keys, c.order, c.counts(), strict=True)):
                    k, n = keys[order], n[order].astype(np.uint32)
                    edges = np.searchsorted(k, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(1, dtype=np.int64)
                    edges = np.append(edges, len(k))
                    for bucket in np.flatnonzero(np.diff(edges)):
                        i, j = edges[bucket], edges[bucket + 1]
                        rows.append((r["chunk"], kind, int(bucket), _squeeze(np.diff(k[i:j], prepend=np.uint64(0))), _squeeze(n[i:j])))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["chunk", "kind", "bucket", "keys", "counts"])

    return run


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """Totals of the keys of one bucket, for each chunk that asked; and of words, the tokens and types (chunk -1)."""
    keys = [np.cumsum(_widen(k, np.uint64), dtype=np.uint64) for k in pdf["keys"]]
    counts = np.concatenate([_widen(n, np.uint32) for n in pdf["counts"]])
    u, inv = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(inv, weights=counts, minlength=len(u)).astype(np.uint64)
    stops = np.cumsum([len(k) for k in keys])
    out = [_squeeze(totals[inv[s - len(k) : s]]) for k, s in zip(keys, stops, strict=True)]
    kind = int(pdf["kind"].iloc[0])
    rows = pd.DataFrame({"chunk": pdf["chunk"], "kind": kind, "bucket": pdf["bucket"], "totals": out, "tokens": 0, "types": 0})
    if kind == 0:
        rows.loc[len(rows)] = [-1, 0, pdf["bucket"].iloc[0], b"", int(totals.sum()), int((totals > 0).sum())]
    return rows


def _with_totals(asked: pd.DataFrame, answers: pd.DataFrame):
    """The chunk and, for each of its tokens, the counts of the word, the context and the pair."""
    r = asked.iloc[0]
    c = Chunk(r["lens"], r["train"], r["codes"], r["hashes"])
    found = []
    for kind in (0, 1):
        mine = answers[answers["kind"] == kind].sort_values("bucket")
        total = np.empty(len(c.keys[kind]), dtype=np.int64)
        total[c.order[kind]] = np.concatenate([np.zeros(0, dtype=np.int64), *[_widen(t, np.uint64).astype(np.int64) for t in mine["totals"]]])
        found.append(total)
    words = np.append(found[0], found[0][c.end])  # as many starts as ends
    return c, words[c.codes], words[c.context], found[1][c.pair]


def level(context: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else 1 + floor(log2(count))."""
    return np.where(context > 0, np.minimum(1 + np.floor(np.log2(np.maximum(context, 1))), LEVELS - 1), 0).astype(np.int64)


def _cell(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.rint(STEP * np.log2(np.maximum(p, 1e-300))), 10_000).astype(np.int64)


def learn(cells: pd.DataFrame, floor: float, rounds: int = 60) -> np.ndarray:
    """Weights (order 2, 1, 0) a level, by expectation-maximisation on cells (level, two, one, n)."""
    out = np.tile(np.array([0.0, 0.9, 0.1]), (LEVELS, 1))
    value = lambda c: np.where(c == 10_000, 0.0, np.exp2(np.where(c == 10_000, 0, c) / STEP))
    for b, part in cells.groupby("level"):
        p = np.stack([value(part["two"].to_numpy(dtype=np.int64)), value(part["one"].to_numpy(dtype=np.int64)), np.full(len(part), floor)], axis=1)
        n, w = part["n"].to_numpy(dtype=np.float64), np.array([0.3, 0.4, 0.3])
        for _ in range(rounds):
            share = w * p
            w = (n @ (share / share.sum(axis=1, keepdims=True))) / n.sum()
        w = np.maximum(w, [0.0, 1e-6, 1e-6])
        out[int(b)] = w / w.sum()
    out[0] = [0.0, out[1][1] + out[1][0], out[1][2]]
    for b in range(2, LEVELS):  # levels no training context has
        if b not in set(cells["level"]):
            out[b] = out[b - 1]
    return out


def score(docs: DataFrame, mod: int = MOD, held_out: int = HELD_OUT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
    kind = dict(docs.dtypes)["doc_id"]
    split = docs.select("doc_id", "text", (crc_mod(F.col("doc_id"), mod) != held_out).alias("train"))
    chunks = materialize(split.mapInArrow(_chunks, f"chunk long, doc_ids array<{kind}>, lens binary, train binary, codes binary, hashes binary"), "lm-chunks")
    size = chunks.agg(F.sum(F.length("codes") + F.length("hashes"))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(size / 2 / BUCKET_KEYS, 1))))
    asked = chunks.drop("doc_ids").mapInArrow(_requests(bits), "chunk long, kind int, bucket int, keys binary, counts binary")
    answers = materialize(asked.groupBy("kind", "bucket").applyInPandas(_answer, "chunk long, kind int, bucket int, totals binary, tokens long, types long"), "lm-answers")
    n, v = (x or 0 for x in answers.where("chunk = -1").agg(F.sum("tokens"), F.sum("types")).first())
    floor = 1.0 / (v + 1)
    by_chunk = answers.where("chunk >= 0").select("chunk", "kind", "bucket", "totals").groupBy("chunk")

    def deleted(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame({"level": [], "two": [], "one": [], "n": []}).astype("int64")
        c, word, context, pair = (x for x in _with_totals(left, right))
        t = c.train_token
        word, context, pair = word[t], context[t], pair[t]
        two = np.where(context > 1, (pair - 1) / np.maximum(context - 1, 1), 0.0)
        one = (word - 1) / max(n - 1, 1)
        cell, k = np.unique(np.stack([level(context), _cell(two), _cell(one)]), axis=1, return_counts=True) if len(word) else (np.zeros((3, 0), dtype=np.int64), np.zeros(0, dtype=np.int64))
        return pd.DataFrame({"level": cell[0], "two": cell[1], "one": cell[2], "n": k})

    cells = chunks.drop("doc_ids").groupBy("chunk").cogroup(by_chunk).applyInPandas(deleted, "level long, two long, one long, n long")
    weights = learn(cells.groupBy("level", "two", "one").agg(F.sum("n").alias("n")).toPandas(), floor)

    def scored(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if left.empty:
            return pd.DataFrame({x: [] for x in names})
        c, word, context, pair = _with_totals(left, right)
        w = weights[level(context)]
        p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(n, 1) + w[:, 2] * floor
        if not n:
            p = np.ones(len(word))
        base = segment_sums(np.log10((word + 1) / (n + v + 1)), c.offsets)
        known = segment_sums(word > 0, c.offsets)
        columns = [list(left["doc_ids"].iloc[0]), ~c.train, np.diff(c.offsets), known.astype(np.int64), np.full(len(c.train), n), base, segment_sums(np.log10(p), c.offsets)]
        return pd.DataFrame(dict(zip(names, columns, strict=True)))

    return chunks.groupBy("chunk").cogroup(by_chunk).applyInPandas(scored, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
