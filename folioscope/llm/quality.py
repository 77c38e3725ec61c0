"""Quality classifier: supervised subword embeddings.

A document is the average of the learned vectors of its features, hashed to a fixed number of rows: each word, the
character n-grams of each word between word marks, and one shared feature for a word that repeats the one before it
(the word bigram of equal words).  A softmax over two outputs reads that average.  Vectors and outputs are trained
together by stochastic gradient descent in numpy on a bounded sample of labelled documents (`TRAIN_ROWS` a
class).  Scoring needs no vectors: the margin is linear in the average, so each row of the
table becomes one number, and each distinct word of a batch is looked up once.

Defined results: null and empty texts have no features and score by the bias alone; without labelled rows of both
classes the score is the share of label 1 (0.5 without any); repeated rows score alike; an empty table gives an empty
result.  Only doc_id and text are read; other columns pass through `classify` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, encode_words, give_back, pieces, segment_sums, table
from .labelled import labelled_sample
from .subwords import codepoints, mix64, windows

BUCKETS = 1 << 17
DIM = 8
NGRAMS = (2, 3, 4)
EPOCHS = 12
BATCH = 32
RATE = 0.6
TRAIN_ROWS = 800
THRESHOLD = 0.3
MOD, HELD_OUT = 5, 0


@dataclass
class Model:
    """margin = bias + mean of weight over a document's features; score = logistic of margin."""

    weight: np.ndarray
    bias: float


def word_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the table for each feature of each word, and the word of each."""
    cp, starts = codepoints(words, 1, 1)
    parts = [windows(cp, starts, n) for n in NGRAMS]
    whole = np.zeros(len(words), dtype=np.uint64)
    if len(words):
        pos = np.arange(len(cp)) - np.repeat(starts[:-1], np.diff(starts))
        mixed = mix64(cp * np.uint64(0x9E3779B97F4A7C15) + pos.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        whole = mix64(np.add.reduceat(mixed, starts[:-1]))
    rows = np.concatenate([whole, *[h for h, _ in parts]])
    owner = np.concatenate([np.arange(len(words)), *[w for _, w in parts]])
    return (rows % np.uint64(BUCKETS - 1)).astype(np.int64) + 1, owner


def repeats(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """1 for each word equal to the one before it in its document.  Row 0 of the table stands for it."""
    same = np.zeros(len(codes))
    same[1:] = codes[1:] == codes[:-1]
    same[offsets[:-1][np.diff(offsets) > 0]] = 0
    return same


def margins(text: pa.Array, model: Model) -> np.ndarray:
    words, codes, offsets = encode_words(text, lower=False)
    rows, owner = word_features(words)
    value = np.bincount(owner, weights=model.weight[rows], minlength=len(words))
    count = np.bincount(owner, minlength=len(words)).astype(np.float64)
    same = repeats(codes, offsets)
    total = segment_sums(value[codes] + same * model.weight[0], offsets)
    n = segment_sums(count[codes] + same, offsets)
    return model.bias + total / np.maximum(n, 1)


def sample_features(sample: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features of the documents of a sample, a slice of about a megabyte of text at a time."""
    at = sample.schema.names.index("text")
    return [f for b in sample.to_batches() for piece in pieces(b, at, 1 << 20) for f in document_features(piece.column(at))]


def document_features(text: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct rows and their shares of each document."""
    out = []
    words, codes, offsets = encode_words(text, lower=False)
    rows, owner = word_features(words)
    order = np.argsort(owner, kind="stable")
    rows, bounds = rows[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))])
    same = repeats(codes, offsets)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        w, k = np.unique(codes[a:b], return_counts=True)
        f = np.concatenate([rows[bounds[x] : bounds[x + 1]] for x in w] + [np.zeros(1, dtype=np.int64)])
        c = np.concatenate([np.repeat(k, bounds[w + 1] - bounds[w]), [same[a:b].sum()]]).astype(np.float64)
        u, inv = np.unique(f, return_inverse=True)
        s = np.bincount(inv, weights=c)
        out.append((u.astype(np.int32), (s / max(s.sum(), 1)).astype(np.float32)))
    return out


def train(features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, prior: float, seed: int = 1) -> Model:
    """prior: share of label 1 among all labelled rows; the sample holds the classes as it will, and rows weigh so that
    the scores follow the prior."""
    share = float(np.mean(labels)) if len(labels) else prior
    if not len(labels) or not 0 < share < 1:
        p = min(max(share, 1e-3), 1 - 1e-3)
        return Model(np.zeros(BUCKETS), float(np.log(p / (1 - p))))
    weigh = np.where(labels == 1, prior / share, (1 - prior) / (1 - share))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (2, DIM)).astype(np.float32), np.zeros(2, dtype=np.float32)
    onehot = np.eye(2, dtype=np.float32)[labels]
    steps, done = EPOCHS * -(-len(labels) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            rows = np.concatenate([features[j][0] for j in pick])
            w = np.concatenate([features[j][1] for j in pick])
            doc = np.repeat(np.arange(len(pick)), [len(features[j][0]) for j in pick])
            hidden = np.stack([np.bincount(doc, weights=w * vectors[rows, d], minlength=len(pick)) for d in range(DIM)], axis=1).astype(np.float32)
            z = hidden @ out.T + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = (p - onehot[pick]) * weigh[pick, None].astype(np.float32)
            rate = np.float32(RATE * (1 - done / steps))
            back = g @ out
            out -= rate * (g.T @ hidden)
            bias -= rate * 0.1 * g.sum(axis=0)
            np.add.at(vectors, rows, -(rate * 8) * w[:, None] * back[doc])
            done += 1
    delta = out[1] - out[0]
    return Model((vectors @ delta).astype(np.float64), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    sample = labelled_sample(docs, labels, "quality", MOD, HELD_OUT, rows)
    got = sample.orderBy("doc_id").toArrow()
    share = labels.where(F.col("quality").isin(0, 1) & (crc_mod(F.col("doc_id"), MOD) != HELD_OUT)).agg(F.avg("quality")).first()[0]
    y = np.asarray(got["label"].combine_chunks()).astype(np.int64) if got.num_rows else np.zeros(0, dtype=np.int64)
    model = train(sample_features(got) if got.num_rows else [], y, 0.5 if share is None else float(share))
    give_back()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in (x for batch in batches for x in pieces(batch, 1, 1 << 20)):
            z = margins(b.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-z)))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    def run(batches):
        for b in (x for batch in batches for x in pieces(batch, at, 1 << 20)):
            keep = 1 / (1 + np.exp(-margins(b.column(at), model.value))) >= threshold
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), MOD) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
