"""Vectorised character n-grams of many words at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX
    return h ^ (h >> np.uint64(27))


def codepoints(words: pa.Array, left: int, right: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each with `left` marks (1) before and `right` marks (2) after it, and the start of each
    word.  Starts come from lengths, so marks inside words are harmless."""
    lens = np.asarray(pc.utf8_length(words)).astype(np.int64) + left + right
    starts = np.concatenate([[0], np.cumsum(lens)])
    if not len(words):
        return np.zeros(0, dtype=np.uint64), starts
    sep = "\x02" * right + "\x01" * left
    text = "\x01" * left + sep.join(words.to_pylist()) + "\x02" * right
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64), starts


def windows(cp: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all n-grams that lie within one word, and the index of the word of each."""
    if len(cp) < n:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
    m = len(cp) - n + 1
    h = np.full(m, n, dtype=np.uint64)
    for k in range(n):
        h = (h ^ cp[k : k + m]) * _MULT
        h ^= h >> np.uint64(29)
    word = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))[:m]
    inside = np.arange(m) + n <= starts[1:][word]
    return mix64(h[inside]), word[inside]
