"""Toxicity: class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models, one of toxic and one of ordinary text, read each lower-cased word as characters
between word marks.  The highest order holds the counts of its class; what a class has not seen backs off to one shared
distribution of lower order, built from the continuation counts of both classes, so rare expressions are smoothed alike.
A document's evidence is the difference of the two log-likelihoods divided by its characters, and the largest such
difference of any run of `WINDOW` words; a logistic of both, fitted on a third of the sample that the models did not
see, gives the score.  As the backoff is shared, characters whose context neither class has seen differ by exactly 0, so
two tables hold the whole comparison: of seen n-grams, and of seen contexts (for other characters after them).

Models are fitted on a bounded sample of labelled documents (`TRAIN_ROWS` a class).

Defined results: null and empty texts have no evidence (0, 0); without labelled rows of both classes every score is 0
(1 if all are toxic); repeated rows score alike; an empty table gives an empty result.  Only doc_id and text are read;
other columns pass through `keep_clean` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, encode_words, give_back, pieces, segment_sums, table
from .labelled import labelled_sample
from .subwords import codepoints, windows

ORDER = 5
DISCOUNT = 0.75
WINDOW = 2
#: Runs count as at least so many characters, so that one short odd word is weak evidence.
LEAST_CHARS = 12
TRAIN_ROWS = 1000
THRESHOLD = 0.3
MOD, HELD_OUT = 4, 2


@dataclass
class Counts:
    """n-grams of one kind with a number each, in order of their hash."""

    key: np.ndarray
    value: np.ndarray

    def get(self, key: np.ndarray, default: float = 0.0) -> np.ndarray:
        if not len(self.key):
            return np.full(len(key), default)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.value[at], default)


def tally(keys: np.ndarray, weights: np.ndarray | None = None) -> Counts:
    u, inv = np.unique(keys, return_inverse=True)
    return Counts(u, np.bincount(inv, weights=weights, minlength=len(u)).astype(np.float64))


@dataclass
class Model:
    """Log-likelihood ratios of seen n-grams and of seen contexts, and the logistic of (mean, largest run)."""

    gram: Counts
    context: Counts
    logistic: np.ndarray


class Grams:
    """n-grams of all orders of the words of some documents, with how often each word occurs."""

    def __init__(self, words: pa.Array, occurs: np.ndarray):
        self.cp, self.starts = codepoints(words, ORDER - 1, 1)
        self.cp = self.cp.astype(np.uint32)
        self.occurs = occurs

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams, and the word of each."""
        return windows(self.cp, self.starts, n)

    def pairs(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each n-gram: its hash, its context's (the first n - 1), its suffix's (the last n - 1).  Windows of order n
        end one character after windows of order n - 1 that begin with them."""
        lower, at = self.of(n - 1)[0], _prefix(self.starts, n)
        return self.of(n)[0], lower[at], lower[at + 1]


def _prefix(starts: np.ndarray, n: int) -> np.ndarray:
    """Index, among windows of order n - 1, of the one that each window of order n begins with."""
    lens = np.diff(starts)
    many, fewer = np.maximum(lens - n + 1, 0), np.maximum(lens - n + 2, 0)
    base = np.concatenate([[0], np.cumsum(fewer)])[:-1]
    first = np.concatenate([[0], np.cumsum(many)])[:-1]
    return np.arange(many.sum()) + np.repeat(base - first, many)


def kneser_ney(ordinary: Grams, toxic: Grams) -> tuple[Counts, Counts]:
    """The two tables of log-likelihood ratios."""
    both = [ordinary, toxic]
    # shared lower orders: continuation counts, that is distinct left neighbours, of both classes together
    shared: Counts | None = None
    for n in range(1, ORDER):
        up = [g.pairs(n + 1)[::2] for g in both]
        at = np.unique(np.concatenate([u[0] for u in up]), return_index=True)[1]
        cont = tally(np.concatenate([u[1] for u in up])[at])
        del up, at
        if n == 1:
            total = cont.value.sum()
            shared = Counts(cont.key, (np.maximum(cont.value - DISCOUNT, 0) + DISCOUNT * len(cont.key) / (len(cont.key) + 1)) / max(total, 1))
            continue
        gram, context, suffix = (np.concatenate([g.pairs(n)[k] for g in both]) for k in range(3))
        u, first = np.unique(gram, return_index=True)
        context, suffix = context[first], suffix[first]
        c = cont.get(u)
        mass, kept = tally(context, c), tally(context, (c > 0).astype(np.float64))
        m = np.maximum(mass.get(context), 1e-9)
        p = np.maximum(c - DISCOUNT, 0) / m + np.minimum(DISCOUNT * kept.get(context) / m, 1) * shared.get(suffix, 1e-6)
        shared = Counts(u, np.maximum(p, 1e-12))
    grams, contexts, suffixes = zip(*[g.pairs(ORDER) for g in both], strict=True)
    u, first = np.unique(np.concatenate(grams), return_index=True)
    context, suffix = np.concatenate(contexts)[first], np.concatenate(suffixes)[first]
    below = shared.get(suffix, 1e-6)
    logs, backoffs = [], []
    all_contexts = np.unique(context)
    del suffixes
    for g, gram, ctx in zip(both, grams, contexts, strict=True):
        times = g.occurs[g.of(ORDER)[1]]
        count = tally(gram, times)
        mass = tally(ctx, times)
        at = np.unique(gram, return_index=True)[1]
        kinds = tally(ctx[at])
        lam = Counts(all_contexts, np.where(mass.get(all_contexts) > 0, DISCOUNT * kinds.get(all_contexts) / np.maximum(mass.get(all_contexts), 1), 1.0))
        p = np.maximum(count.get(u) - DISCOUNT, 0) / np.maximum(mass.get(context), 1) + lam.get(context, 1.0) * below
        logs.append(np.log(p))
        backoffs.append(np.log(lam.value))
    return Counts(u, logs[1] - logs[0]), Counts(all_contexts, backoffs[1] - backoffs[0])


def word_evidence(words: pa.Array, gram: Counts, context: Counts) -> tuple[np.ndarray, np.ndarray]:
    """Summed log-likelihood ratio and number of predicted characters of each word."""
    cp, starts = codepoints(words, ORDER - 1, 1)
    h, w = windows(cp, starts, ORDER)
    low, _ = windows(cp, starts, ORDER - 1)
    r = gram.get(h, np.nan)
    lost = np.isnan(r)
    r[lost] = context.get(low[_prefix(starts, ORDER)[lost]], 0.0)
    return np.bincount(w, weights=r, minlength=len(words)), np.bincount(w, minlength=len(words)).astype(np.float64)


def evidence(text: pa.Array, gram: Counts, context: Counts) -> np.ndarray:
    """(mean, largest run) of each document."""
    words, codes, offsets = encode_words(_lower(text), lower=False)
    value, chars = word_evidence(words, gram, context)
    v, n = value[codes], chars[codes]
    total, size = segment_sums(v, offsets), segment_sums(n, offsets)
    mean = total / np.maximum(size, 1)
    largest = np.zeros(len(mean))
    if len(codes):
        # runs begin at every word and end after WINDOW words or with the document
        sv, sn = np.concatenate([[0], np.cumsum(v)]), np.concatenate([[0], np.cumsum(n)])
        stop = np.repeat(offsets[1:], np.diff(offsets))
        a = np.arange(len(codes))
        b = np.minimum(a + WINDOW, stop)
        run = (sv[b] - sv[a]) / np.maximum(sn[b] - sn[a], LEAST_CHARS)
        full = np.diff(offsets) > 0
        largest[full] = np.maximum.reduceat(run, offsets[:-1][full])
    return np.stack([mean, largest], axis=1)


def _lower(text: pa.Array) -> pa.Array:
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    return pc.utf8_lower(text.cast(pa.large_string()))


def grams_of(text: pa.Array) -> Grams:
    words, codes, _ = encode_words(_lower(text), lower=False)
    return Grams(words, np.bincount(codes, minlength=len(words)).astype(np.float64))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Newton steps on standardised columns with a small ridge; the bias comes first."""
    mid, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.concatenate([np.ones((len(x), 1)), (x - mid) / scale], axis=1)
    b = np.zeros(z.shape[1])
    ridge = 1e-2 * np.eye(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (weight * (p - y)) + ridge @ b
        step = np.linalg.solve((z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + ridge, g)
        b -= np.clip(step, -2, 2)
    slope = b[1:] / scale
    return np.concatenate([[b[0] - slope @ mid], slope])


def train(text: pa.Array, labels: np.ndarray, share: float) -> Model | float:
    """share: of toxic rows among all labelled ones.  Gives a constant if the sample lacks a class."""
    fit_on = np.arange(len(labels)) % 3 != 2
    classes = [np.flatnonzero((labels == c) & fit_on) for c in (0, 1)]
    if any(len(np.flatnonzero(labels == c)) < 3 for c in (0, 1)) or any(not len(c) for c in classes):
        return float(len(labels) > 0 and labels.min() == 1)
    gram, context = kneser_ney(*[grams_of(text.take(pa.array(c))) for c in classes])
    rest = np.flatnonzero(~fit_on) if len(np.unique(labels[~fit_on])) == 2 else np.arange(len(labels))
    y = labels[rest].astype(np.float64)
    part = y.mean()
    seen = [evidence(text.take(pa.array(rest[k : k + 64])), gram, context) for k in range(0, len(rest), 64)]
    b = logistic(np.concatenate(seen), y, np.where(y == 1, share / part, (1 - share) / (1 - part)))
    return Model(gram, context, b)


def probabilities(text: pa.Array, model: Model | float) -> np.ndarray:
    if not isinstance(model, Model):
        return np.full(len(text), model)
    x = evidence(text, model.gram, model.context)
    return 1 / (1 + np.exp(-np.clip(model.logistic[0] + x @ model.logistic[1:], -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model | float:
    sample = labelled_sample(docs, labels, "toxic", MOD, HELD_OUT, rows)
    got = sample.orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    share = labels.where(F.col("toxic").isin(0, 1) & (crc_mod(F.col("doc_id"), MOD) != HELD_OUT)).agg(F.avg("toxic")).first()[0]
    if not got.num_rows:
        return 0.0
    model = train(got["text"].combine_chunks(), np.asarray(got["label"].combine_chunks()).astype(np.int64), float(share))
    give_back()
    return model


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """doc_id, score of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in (x for batch in batches for x in pieces(batch, 1, 1 << 20)):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(probabilities(b.column(1), shared.value))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score stays under the threshold, with their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    def run(batches):
        for b in (x for batch in batches for x in pieces(batch, at, 1 << 20)):
            yield b.filter(pa.array(probabilities(b.column(at), model.value) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), MOD) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
