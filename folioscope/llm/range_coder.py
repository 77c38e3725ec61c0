"""Adaptive range coder for token ids, in independently reset, checksummed blocks.

A block holds up to `BLOCK` ids and starts from an empty model.  For the next id, order 2 (the last two ids) and order 1
(the last id) each predict one id, the last one that followed, with a confidence; order 0 ranks the ids seen so far, an
id moving half way to the front when it is used.  One of `SYMBOLS` events is coded with a range coder: order 2 is right,
order 1 is right, the id's rank lies in [2^k - 1, 2^(k+1) - 1), or the id is new; the lower bits of a rank and new ids
follow as plain bits.  The event's distribution mixes adaptive counts that were kept under the confidence of order 2,
under that of order 1, and under the kind of the last event (order 0).

Blocks of a segment are coded side by side, one numpy operation for a step of all of them, which is what makes an
adaptive coder affordable here; nothing of a block's code depends on other blocks.

A segment is: header (magic, version, bits of an id, ids, block length, blocks), then lengths of the codes in 16-bit words, crc32
of the ids of each block (little-endian unsigned 32-bit), and the codes.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 2048
SLOTS = 4096
RANKS = 12  # ranks below 2^12 - 1, more than a block has
SYMBOLS = 16
HIT2, HIT1, NEW = 0, 1, 15
STEP, LIMIT = 24, 1 << 12
MAGIC = b"FSID"
HEADER = struct.Struct("<4sBBxxQII")
_TOP, _BOTTOM = np.uint64(1 << 48), np.uint64(1 << 32)
_S16 = np.uint64(16)


#: Confidence after a prediction was wrong, and right.
_SURE = np.array([[max(s >> 1, 1) for s in range(5)], [min(s + 1, 4) for s in range(5)]], dtype=np.int8).ravel()
_SUMS = np.triu(np.ones((SYMBOLS, SYMBOLS), dtype=np.float32))


class Lanes:
    """The models of n blocks.  Tables are flat, so that a step's rows are taken and put by one index each; counts are whole
    numbers below 2^24, which floats hold and sum exactly."""

    def __init__(self, n: int, ids: int = 0):
        self.n = n
        self.row = np.arange(n)
        self.slots, self.row5, self.symbols = self.row * SLOTS, self.row * 5, self.row * SYMBOLS
        self.guess2 = np.full(n * SLOTS, -1, dtype=np.int32)
        self.guess1 = np.full(n * SLOTS, -1, dtype=np.int32)
        self.sure2 = np.zeros(n * SLOTS, dtype=np.int8)
        self.sure1 = np.zeros(n * SLOTS, dtype=np.int8)
        # one set of counts for each confidence of order 2, each of order 1, each last event
        start = np.array([8, 8, *[2] * RANKS, 2, 8], dtype=np.float32)
        self.counts = [np.tile(start, (n * k, 1)) for k in (5, 5, SYMBOLS)]
        self.list = np.full(n * BLOCK, -1, dtype=np.int32)
        self.seen = np.zeros(n, dtype=np.int64)
        self.ids = ids
        self.rank = np.full(n * ids, -1, dtype=np.int16) if ids else None
        self.last = np.zeros(n, dtype=np.int64)
        self.last2 = np.zeros(n, dtype=np.int64)
        self.event = np.full(n, NEW)

    def look(self, m: int) -> None:
        """Predictions and the event distribution of the first m blocks."""
        last, last2, base = self.last[:m], self.last2[:m], self.slots[:m]
        self.at2 = base + (((last * 40503) ^ (last2 * 30011 + (last2 >> 7))) & (SLOTS - 1))
        self.at1 = base + ((last ^ (last >> 5)) & (SLOTS - 1))
        self.g2, self.g1 = self.guess2.take(self.at2), self.guess1.take(self.at1)
        self.s2, self.s1 = self.sure2.take(self.at2), self.sure1.take(self.at1)
        self.which = [self.row5[:m] + self.s2, self.row5[:m] + self.s1, self.symbols[:m] + self.event[:m]]
        self.mixed = self.counts[0].take(self.which[0], axis=0)
        self.mixed += self.counts[1].take(self.which[1], axis=0)
        self.mixed += self.counts[2].take(self.which[2], axis=0)
        self.upto = self.mixed @ _SUMS
        self.total = self.upto[:, -1].astype(np.uint64)

    def range(self, m: int, event: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the events' part of the distribution starts, and its width."""
        at = self.symbols[:m] + event
        wide = self.mixed.take(at)
        return (self.upto.take(at) - wide).astype(np.uint64), wide.astype(np.uint64)

    def learn(self, m: int, event: np.ndarray, rank: np.ndarray, ids: np.ndarray) -> None:
        for counts, which in zip(self.counts, self.which, strict=True):
            flat, at = counts.reshape(-1), which * SYMBOLS + event
            c = flat.take(at) + np.float32(STEP)
            flat[at] = c
            full = c > LIMIT // 4
            if full.any():
                some = which[full]
                counts[some] = np.floor((counts[some] + 1) / 2)
        self.event[:m] = event
        for guess, sure, at, g, s in ((self.guess2, self.sure2, self.at2, self.g2, self.s2), (self.guess1, self.sure1, self.at1, self.g1, self.s1)):
            sure[at] = _SURE.take(s + 5 * (g == ids))
            guess[at] = np.where(s < 2, ids, g)
        # order 0: a ranked id moves half way to the front; a new one joins the list
        new = event == NEW
        ranked = np.flatnonzero(event >= 2)
        r = np.where(new, self.seen[:m], rank).take(ranked)
        i, front, base = ids.take(ranked), r >> 1, ranked * BLOCK
        other = self.list.take(base + front)
        self.list[base + r] = other
        self.list[base + front] = i
        if self.rank is not None:
            base = ranked * self.ids
            held = np.flatnonzero(other >= 0)
            self.rank[base.take(held) + other.take(held)] = r.take(held)
            self.rank[base + i] = front
        self.seen[:m] += new
        self.last2[:m] = self.last[:m]
        self.last[:m] = ids


def _active(lens: np.ndarray, t: int) -> int:
    """Blocks with more than t ids; only the last block is shorter than others."""
    return len(lens) if lens[-1] > t else len(lens) - 1


def _encode(blocks: np.ndarray, lens: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    n, width = blocks.shape
    lanes = Lanes(n, int(blocks.max()) + 1)
    low, span = np.zeros(n, dtype=np.uint64), np.full(n, 2**64 - 1, dtype=np.uint64)
    out, pos = np.zeros((n, 3 * width + 8), dtype=np.uint16), np.zeros(n, dtype=np.int64)
    flat = out.reshape(-1)

    def put(k, w):
        at = pos.take(k)
        flat[k * out.shape[1] + at] = w
        pos[k] = at + 1

    more, blocks = _more(bits), np.ascontiguousarray(blocks.T)
    for t in range(width):
        m = _active(lens, t)
        ids = blocks[t, :m]
        lanes.look(m)
        rank = lanes.rank.take(lanes.row[:m] * lanes.ids + ids).astype(np.int64)
        event = _EVENT.take(rank + 1)
        event[lanes.g1 == ids] = HIT1
        event[lanes.g2 == ids] = HIT2
        start, s = lanes.range(m, event)
        unit = span[:m] // lanes.total
        low[:m] += start * unit
        s *= unit
        s >>= more.take(event)
        plain = np.where(event == NEW, ids, _LOWER.take(rank + 1))
        plain[event < 2] = 0
        low[:m] += plain.astype(np.uint64) * s
        span[:m] = s
        _shift(low, span, m, put)
        lanes.learn(m, event, rank, ids)
    for _ in range(4):
        out[lanes.row, pos] = (low >> np.uint64(48)).astype(np.uint16)
        pos += 1
        low <<= _S16
    return out, pos


def _shift(low, span, m, each) -> None:
    """Move settled high words out; a span that gets small across a border is cut at it."""
    k, lo, sp = None, low[:m], span[:m]
    while True:
        settled = (lo ^ (lo + sp)) < _TOP
        go = np.flatnonzero(settled | (sp < _BOTTOM))
        if not len(go):
            return
        cut = ~settled.take(go)
        k, lo, sp = go if k is None else k.take(go), lo.take(go), sp.take(go)
        if cut.any():
            sp[cut] = (~lo[cut] + np.uint64(1)) & (_BOTTOM - np.uint64(1))
        each(k, (lo >> np.uint64(48)).astype(np.uint16))
        lo, sp = lo << _S16, sp << _S16
        low[k] = lo
        span[k] = sp


_POWER = np.zeros(BLOCK + 2, dtype=np.int64)
_POWER[1:] = np.floor(np.log2(np.arange(1, BLOCK + 2))).astype(np.int64)
#: The event of an id of rank r that no order predicts, and the lower bits of its rank, at r + 1 (new ids: at 0).
_EVENT = np.concatenate([[NEW], 2 + _POWER[1:]])
_LOWER = np.arange(BLOCK + 2) - (1 << _POWER)


def _more(bits: int) -> np.ndarray:
    """Plain bits that follow each event."""
    return np.array([0, 0, *range(SYMBOLS - 3), bits], dtype=np.uint64)


def _decode(codes: np.ndarray, lens: np.ndarray, width: int, bits: int) -> np.ndarray:
    n = len(lens)
    lanes = Lanes(n)
    low, span = np.zeros(n, dtype=np.uint64), np.full(n, 2**64 - 1, dtype=np.uint64)
    word, pos = np.zeros(n, dtype=np.uint64), np.full(n, 4)
    for k in range(4):
        word = (word << _S16) | codes[:, k].astype(np.uint64)
    ids_out, flat = np.zeros((width, n), dtype=np.uint32), np.ascontiguousarray(codes).reshape(-1)

    def take(k, _):
        at = pos.take(k)
        word[k] = (word.take(k) << _S16) | flat.take(k * codes.shape[1] + np.minimum(at, codes.shape[1] - 1)).astype(np.uint64)
        pos[k] = at + 1

    more = _more(bits)
    for t in range(width):
        m = _active(lens, t)
        lanes.look(m)
        unit = span[:m] // lanes.total
        target = np.minimum((word[:m] - low[:m]) // unit, lanes.total - np.uint64(1)).astype(np.float32)
        passed = np.bitwise_count((lanes.upto <= target[:, None]).view(np.uint64))
        event = (passed[:, 0] + passed[:, 1]).astype(np.int64)
        start, s = lanes.range(m, event)
        low[:m] += start * unit
        s *= unit
        power = np.maximum(event - 2, 0)
        extra = more.take(event)
        s >>= extra
        plain = np.minimum((word[:m] - low[:m]) // s, (np.uint64(1) << extra) - np.uint64(1))
        low[:m] += plain * s
        span[:m] = s
        plain = plain.astype(np.int64)
        rank = np.minimum(np.where(event == NEW, 0, plain + (1 << power) - 1), BLOCK - 1)
        ids = np.where(event == HIT2, lanes.g2, np.where(event == HIT1, lanes.g1, np.where(event == NEW, plain, lanes.list.take(lanes.row[:m] * BLOCK + rank))))
        ids_out[t, :m] = ids
        _shift(low, span, m, take)
        lanes.learn(m, event, rank, ids)
    return np.ascontiguousarray(ids_out.T)


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A segment of ids (below 2^31)."""
    n = len(ids)
    if not n:
        return HEADER.pack(MAGIC, 1, 0, 0, block, 0)
    width = min(block, n)
    count = -(-n // width)
    lens = np.full(count, width)
    lens[-1] = n - width * (count - 1)
    padded = np.zeros(count * width, dtype=np.int64)
    padded[:n] = ids
    bits = max(1, int(padded.max()).bit_length())
    out, pos = _encode(padded.reshape(count, width), lens, bits)
    little = np.ascontiguousarray(ids, dtype="<u4")
    crcs = np.array([zlib.crc32(little[i * width : i * width + k]) for i, k in enumerate(lens)], dtype="<u4")
    body = out[np.arange(out.shape[1])[None, :] < pos[:, None]].astype("<u2").tobytes()
    return HEADER.pack(MAGIC, 1, bits, n, width, count) + pos.astype("<u4").tobytes() + crcs.tobytes() + body


def decode(data: bytes) -> np.ndarray:
    """The ids of a segment; every block is held against its checksum."""
    magic, version, bits, n, width, count = HEADER.unpack_from(data)
    if magic != MAGIC or version != 1:
        raise ValueError("not a segment of token ids")
    if not n:
        return np.zeros(0, dtype=np.uint32)
    pos = np.frombuffer(data, dtype="<u4", count=count, offset=HEADER.size).astype(np.int64)
    crcs = np.frombuffer(data, dtype="<u4", count=count, offset=HEADER.size + 4 * count)
    flat = np.frombuffer(data, dtype="<u2", offset=HEADER.size + 8 * count)
    codes = np.zeros((count, int(pos.max())), dtype=np.uint16)
    codes[np.arange(codes.shape[1])[None, :] < pos[:, None]] = flat
    lens = np.full(count, width)
    lens[-1] = n - width * (count - 1)
    ids = _decode(codes, lens, width, bits)
    for i, k in enumerate(lens):
        if zlib.crc32(np.ascontiguousarray(ids[i, :k], dtype="<u4")) != crcs[i]:
            raise ValueError(f"block {i} of a segment fails its checksum")
    return ids.reshape(-1)[:n]
