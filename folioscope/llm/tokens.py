"""Token ids of many texts at once.

White space separates pre-tokens of the tokenizers used here, so a text's ids are those of its words one after another,
and each distinct word of a batch is encoded once.  Most words are Latin letters with a tail of marks: letters and tail
are pre-tokens of their own, so distinct letter strings are encoded many to a text and told apart by the ids that end
a pre-token.  A process keeps the ids of the letter strings that it met, up to a bound.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import encode_words

END = 1
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters below U+0100 alone.
LETTERS = "^[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
#: Letter strings whose ids a process keeps (some 15 MB).
KNOWN = 1 << 19


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer, and for each id whether it ends a pre-token (None if the vocabulary does not mark that, or if case
    matters: then every distinct word is encoded by itself)."""
    import json
    import os

    # a task has one core; threads of the library would each keep memory of their own
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    suffix = json.loads(tokenizer.to_str())["model"].get("end_of_word_suffix")
    lowers = tokenizer.normalizer is not None and tokenizer.normalizer.normalize_str("AbÉß") == "abéß"
    if not suffix or not lowers:
        return tokenizer, None
    vocab = tokenizer.get_vocab(with_added_tokens=False)
    ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
    for token, i in vocab.items():
        ends[i] = token.endswith(suffix)
    return tokenizer, ends


@lru_cache(maxsize=4)
def _closing(path: str) -> tuple[np.ndarray, np.ndarray] | None:
    """For each id whether it ends a pre-token, and whether it has marks alone."""
    tokenizer, ends = load(path)
    if ends is None:
        return None
    ends, marks = ends.copy(), np.zeros(len(ends), dtype=bool)
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        marks[i] = token[0] in MARKS
    ends[END], marks[END] = True, False
    return ends, marks


def stops(ids: np.ndarray, path: str) -> np.ndarray | None:
    """Ids that end a word with the marks that follow it (None: not known of this tokenizer)."""
    known = _closing(path)
    if known is None:
        return None
    stop = known[0].take(ids, mode="clip")
    stop[:-1] &= ~known[1].take(ids[1:], mode="clip")
    return stop


def gather(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Indices first[0], first[0] + 1, ... of many[0] items, then of the next run, and so on."""
    stop = np.cumsum(many)
    return np.repeat(first - (stop - many), many) + np.arange(stop[-1] if len(stop) else 0)


def _encode_each(tokenizer, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lists = [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
    return np.array([i for x in lists for i in x], dtype=np.uint32), np.array([len(x) for x in lists], dtype=np.int64)


def _encode_letters(tokenizer, ends: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and id counts of words that are one pre-token each."""
    texts = [" ".join(words[i : i + 256]) for i in range(0, len(words), 256)]
    ids = np.concatenate([np.zeros(0, dtype=np.uint32), *[np.array(e.ids, dtype=np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]])
    stop = np.flatnonzero(ends[ids]) + 1
    if len(stop) != len(words):
        return _encode_each(tokenizer, words)
    return ids, np.diff(stop, prepend=0)


class _Known:
    """Letter strings already encoded in this process, with their ids, for one tokenizer: `KNOWN` at most."""

    def __init__(self):
        self.letters = pa.array([], pa.large_string())
        self.ids, self.lens = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)

    def encode(self, tokenizer, ends: np.ndarray, letters: pa.Array) -> tuple[np.ndarray, pa.LargeListArray]:
        """Where each of some distinct letter strings lies in a list of ids, and that list."""
        at = _found(letters, self.letters)
        new = np.flatnonzero(at < 0)
        if len(new) and len(self.letters) + len(new) > KNOWN:
            self.__init__()
            at, new = np.full(len(letters), -1), np.arange(len(letters))
        if len(new):
            at[new] = len(self.letters) + np.arange(len(new))
            fresh = letters.take(pa.array(new))
            ids, lens = _encode_letters(tokenizer, ends, fresh.to_pylist())
            self.letters = pa.concat_arrays([self.letters, fresh])
            self.ids, self.lens = np.concatenate([self.ids, ids]), np.concatenate([self.lens, lens])
        found = at, _lists(self.ids, self.lens)
        if len(self.letters) > KNOWN:
            self.__init__()
        return found


@lru_cache(maxsize=4)
def _known(path: str) -> _Known:
    return _Known()


def _found(values: pa.Array, within: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.index_in(values, value_set=within), -1)).astype(np.int64)


def _lists(flat: np.ndarray, lens: np.ndarray) -> pa.LargeListArray:
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)])), pa.array(flat))


def _flat(lists: pa.LargeListArray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of lists one after another, and how many each has."""
    return np.asarray(lists.flatten()), np.diff(np.asarray(lists.offsets))


def _tails(words: pa.Array, stems: pa.Array) -> pa.Array:
    """What follows the stem of each word."""
    _, offsets, data = words.buffers()
    stop = np.frombuffer(offsets, dtype=np.int64)[words.offset + 1 : words.offset + 1 + len(words)]
    many = np.asarray(pc.subtract(pc.binary_length(words), pc.binary_length(stems))).astype(np.int64)
    tails = np.frombuffer(data, dtype=np.uint8)[gather(stop - many, many)] if many.any() else np.zeros(0, dtype=np.uint8)
    return pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(np.concatenate([[0], np.cumsum(many)])), pa.py_buffer(tails.tobytes()))


def _encode_distinct(words: pa.Array, path: str) -> pa.LargeListArray:
    """Ids of each of some distinct words."""
    tokenizer, ends = load(path)
    if ends is None:
        return _lists(*_encode_each(tokenizer, words.to_pylist()))
    stems = pc.utf8_rtrim(words, characters=MARKS)
    plain = pc.match_substring_regex(stems, LETTERS)
    # words of letters and a tail; of others the whole word is the tail
    stems = pc.if_else(plain, stems, pa.scalar("", pa.large_string()))
    letters = pc.utf8_lower(stems).dictionary_encode()
    tails = _tails(words, stems).dictionary_encode()
    stem_at, stem_ids = _known(path).encode(tokenizer, ends, letters.dictionary.filter(pc.not_equal(letters.dictionary, "")))
    tail_ids = _lists(*_encode_each(tokenizer, tails.dictionary.to_pylist()))
    none = pc.fill_null(pc.index_in(pa.scalar("", pa.large_string()), value_set=letters.dictionary), -1).as_py()
    if none >= 0:  # no letters, no ids
        stem_at = np.insert(stem_at, none, len(stem_ids) + len(tail_ids))
    parts = pa.concat_arrays([stem_ids, tail_ids, pa.array([[]], stem_ids.type)])
    pair = np.stack([stem_at[np.asarray(letters.indices)], len(stem_ids) + np.asarray(tails.indices).astype(np.int64)], axis=1)
    flat, many = _flat(parts.take(pa.array(pair.ravel())))
    return _lists(flat, many.reshape(-1, 2).sum(axis=1))


def token_ids(text: pa.Array, path: str, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts (null: empty), each followed by `end`, and the offsets of the texts."""
    return words_and_ids(text, path, end)[:2]


def words_and_ids(text: pa.Array, path: str, end: int = END) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and their offsets as `token_ids` gives them; codes of the words and their offsets."""
    words, codes, offsets = encode_words(text, lower=False)
    lists = _encode_distinct(words, path)
    lists = pa.concat_arrays([lists, pa.array([[end]], lists.type)])
    ended = np.insert(codes, offsets[1:], len(lists) - 1)
    taken = lists.take(pa.array(ended))
    id_offsets = np.asarray(taken.offsets)[offsets + np.arange(len(offsets))]
    return np.asarray(taken.flatten()), id_offsets, codes, offsets
