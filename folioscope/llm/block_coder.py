"""Version 2 of the code of token ids: the predictions and blocks of range_coder over units of a few ids.

A unit is a run of ids, as many as 64 bits hold at most, that the caller lets end where it likes (words, for text); a segment
holds its distinct units once and codes their numbers, so a step of the adaptive model passes several ids.  What the model
predicts is the same: order 2 and order 1 guess one unit each with a confidence, order 0 ranks the units seen so far, and one
event, range-coded with the mixed counts of three contexts, says which of them is right.  What differs:

- Units are numbered again in a block, in order of first appearance.  The model works on these small numbers: a guess and
  its confidence are one 16-bit word, order 1 has a slot of its own for every number, and the list of order 0 begins as
  0, 1, 2, ..., so a new unit stands at its place in it already.  New units of blocks are plain bits behind the codes.
- Counts are kept in 16 bits, halved every `HALVE` steps where one has passed `LIMIT`.
- The coder's span is a whole number below 2^48 in a double, where quotients of whole numbers round down exactly; words of
  16 bits are moved out with carries, which are added when all words are there.

A segment is: header (magic, version, bits of a unit's number, ids, block length in units, blocks), `MORE` (units, distinct
units, bits of an id, ids that 64 bits hold), then by block the number of words of its code, the number of its distinct
units and the crc32 of its ids (little-endian unsigned 32-bit), the codes, the new units of the blocks, and the distinct
units in order: the higher bits of their first ids as gaps in unary, the lower ones, how many ids follow each, and those.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa

from . import range_coder
from .range_coder import HEADER, HIT1, HIT2, MAGIC
from .tokens import gather

BLOCK = 2048
VERSION = 2
MORE = struct.Struct("<QIBBxx")
SLOTS = 4096
NEW, SYMBOLS = 14, 16  # 15 events; rows of counts are of 16
STEP, LIMIT, HALVE = 32, 1024, 32
#: Rows of counts of a block: 5 confidences of order 2, 5 of order 1, the last event.
ROWS = 10 + 15
EMPTY = -8
#: Blocks numbered at once.
CHUNK = 64
#: Entries between the tables of neighbouring blocks: at a power of two their busy ends would share few sets of the cache.
APART = 32
_W16, _W32 = 2.0**16, 2.0**32

_START = np.array([8, 8, *[2] * 12, 8, 0], dtype=np.uint16)
_SUMS = np.triu(np.ones((SYMBOLS, SYMBOLS), dtype=np.float32))
#: What is added to a guess that stays: a right one is surer (4 at most), a wrong one half as sure; by confidence + 8 if right.
_SURER = np.array([0, 0, -1, -2, -2, 0, 0, 0, 1, 1, 1, 1, 0, 0, 0, 0], dtype=np.int16)
_POWER = np.floor(np.log2(np.arange(1, BLOCK + 1))).astype(np.int64)
#: Of a rank: its event, and the lower bits that follow; a new id has rank -1.
_EVENT, _LOWER = np.append(2 + _POWER, NEW), np.append(np.arange(1, BLOCK + 1) - (1 << _POWER), 0).astype(np.float64)
#: Of an event: the least rank, and one over the number of values of the lower bits.
_LEAST = np.array([0, 0, *[(1 << k) - 1 for k in range(12)], 0], dtype=np.int64)
_SHARE = np.array([1, 1, *[2.0**-k for k in range(12)], 1])


class Lanes:
    """The models of n blocks, side by side."""

    def __init__(self, n: int, width: int):
        row = np.arange(n)
        self.slots, self.places, self.symbols = row * (SLOTS + APART), row * (width + APART), row * SYMBOLS
        self.rows2, self.rows1, self.rows0 = row * ROWS, row * ROWS + 5, row * ROWS + 10
        # guess * 8 + confidence
        self.two = np.full(n * (SLOTS + APART), EMPTY, dtype=np.int16)
        self.one = np.full(n * (width + APART), EMPTY, dtype=np.int16)
        self.counts = np.tile(_START, (n * ROWS, 1))
        self.flat = self.counts.reshape(-1)
        self.list = np.tile(np.arange(width + APART, dtype=np.int16), n)
        self.last, self.last2 = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        self.row0 = self.rows0 + NEW
        self.steps = 0

    def look(self, m: int) -> None:
        """Guesses and the event distribution of the first m blocks: borders of events in `mixed`."""
        last = self.last[:m]
        # frequent ids have small numbers, and their pairs neighbouring slots
        mix = last << 5
        self.at2 = mix ^ self.last2[:m]
        self.at2 ^= mix >> 9
        self.at2 &= SLOTS - 1
        self.at2 += self.slots[:m]
        self.at1 = self.places[:m] + last
        self.p2, self.p1 = self.two.take(self.at2), self.one.take(self.at1)
        self.s2, self.s1 = (self.p2 & 7).astype(np.int64), (self.p1 & 7).astype(np.int64)
        self.g2, self.g1 = self.p2 >> 3, self.p1 >> 3
        self.which = [self.rows2[:m] + self.s2, self.rows1[:m] + self.s1, self.row0[:m]]
        mixed = self.counts.take(self.which[0], axis=0)
        mixed += self.counts.take(self.which[1], axis=0)
        mixed += self.counts.take(self.which[2], axis=0)
        self.mixed = mixed.astype(np.float32)
        self.upto = self.mixed @ _SUMS
        self.total = self.upto[:, -1].astype(np.float64)

    def range(self, m: int, event: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the events' part of the distribution starts, and its width."""
        at = self.symbols[:m] + event
        wide = self.mixed.take(at)
        return (self.upto.take(at) - wide).astype(np.float64), wide.astype(np.float64)

    def learn(self, m: int, event: np.ndarray, ids: np.ndarray, ids16: np.ndarray, right2: np.ndarray, right1: np.ndarray) -> None:
        """Counts and guesses after the events and the (numbered) ids."""
        for at in self.which:
            at = at << 4
            at += event
            c = self.flat.take(at)
            c += np.uint16(STEP)
            self.flat[at] = c
        fresh = ids16 << 3
        fresh |= 1
        for table, at, p, s, right in ((self.two, self.at2, self.p2, self.s2, right2), (self.one, self.at1, self.p1, self.s1, right1)):
            surer = right.astype(np.int64)
            surer <<= 3
            surer += s
            p += _SURER.take(surer)
            # one that was wrong and not sure gives way
            np.copyto(p, fresh, where=surer < 2)
            table[at] = p
        self.row0 = self.rows0[:m] + event
        self.last, self.last2 = ids, self.last
        self.steps += 1
        if not self.steps % HALVE:
            full = np.flatnonzero(self.flat > LIMIT)
            if len(full):
                full = np.unique(full // SYMBOLS)
                self.counts[full] = (self.counts.take(full, axis=0) + 1) >> 1


def _active(lens: np.ndarray, t: int) -> int:
    """Blocks with more than t ids; only the last block is shorter than others."""
    return len(lens) if lens[-1] > t else len(lens) - 1


def _numbered(blocks: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each block numbered in order of first appearance, and where an id is new."""
    n, width = blocks.shape
    shift = BLOCK.bit_length() - 1
    keys = blocks.astype(np.uint32 if bits + shift <= 32 else np.uint64)
    keys <<= shift
    keys |= np.arange(width, dtype=keys.dtype)
    keys.sort(axis=1)
    at = (keys & (BLOCK - 1)).astype(np.int64) + np.arange(n)[:, None] * width
    keys >>= shift
    first = np.ones((n, width), dtype=bool)
    np.not_equal(keys[:, 1:], keys[:, :-1], out=first[:, 1:])
    at, first = at.reshape(-1), first.reshape(-1)
    new = np.zeros(n * width, dtype=bool)
    came = at[first]
    new[came] = True
    number = np.cumsum(new.reshape(n, width), axis=1, dtype=np.int16).reshape(-1) - np.int16(1)
    numbers = np.empty(n * width, dtype=np.int16)
    numbers[at] = np.repeat(number.take(came), np.diff(np.append(np.flatnonzero(first), n * width)))
    return numbers.reshape(n, width), new.reshape(n, width)


def _encode(numbers: np.ndarray, news: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the codes of blocks (columns) of numbered ids, and how many each has."""
    width, n = numbers.shape
    lanes = Lanes(n, width)
    rank = np.full(len(lanes.list), -1, dtype=np.int16)
    low, span = np.zeros(n), np.full(n, _W16 * _W32)
    # an id takes 27 bits at most
    room = 2 * width + APART
    words, begin = np.zeros(n * room, dtype=np.uint32), np.arange(n) * room
    pos = begin.copy()
    for t in range(width):
        m = _active(lens, t)
        ids16, new, places = numbers[t, :m], news[t, :m], lanes.places[:m]
        ids = ids16.astype(np.int64)
        lanes.look(m)
        right2, right1 = lanes.g2 == ids16, lanes.g1 == ids16
        hit = right2 | right1
        r = rank.take(places + ids).astype(np.int64)
        np.copyto(r, 0, where=hit)
        event, plain = _EVENT.take(r), _LOWER.take(r)
        np.copyto(event, HIT1, where=right1)
        np.copyto(event, HIT2, where=right2)
        np.copyto(r, ids, where=new)
        start, s = lanes.range(m, event)
        unit = np.floor(span[:m] / lanes.total)
        start *= unit
        s *= unit
        s *= _SHARE.take(event)
        np.floor(s, out=s)
        plain *= s
        start += plain
        low[:m] += start
        span[:m] = s
        k = (s < _W32).nonzero()[0]
        while len(k):
            lo, at = low.take(k), pos.take(k)
            word = np.floor(lo * (1 / _W32))
            words[at] = word.astype(np.uint32)
            at += 1
            pos[k] = at
            word *= _W32
            lo -= word
            lo *= _W16
            low[k] = lo
            s = span.take(k) * _W16
            span[k] = s
            k = k[s < _W32]
        # order 0: an id that was ranked moves half way to the front
        half = r >> 1
        front = places + half
        other = lanes.list.take(front)
        moved = np.where(hit, other, ids16)
        lanes.list[places + r] = other
        lanes.list[front] = moved
        rank[places + other] = r.astype(np.int16)
        rank[places + moved] = half.astype(np.int16)
        lanes.learn(m, event, ids, ids16, right2, right1)
    for _ in range(3):
        word = np.floor(low * (1 / _W32))
        words[pos] = word
        pos += 1
        low = (low - word * _W32) * _W16
    k = np.flatnonzero(words >> 16)
    while len(k):
        words[k] &= 0xFFFF
        k = k - 1
        words[k] += 1
        k = k[words.take(k) > 0xFFFF]
    pos -= begin
    return words.take(gather(begin, pos)).astype("<u2"), pos


def _decode(words: np.ndarray, pos: np.ndarray, lens: np.ndarray, width: int) -> np.ndarray:
    """Numbered ids of blocks; those of broken codes are any numbers below the block's length."""
    n = len(lens)
    lanes, words = Lanes(n, width), words.astype(np.float64)
    at = np.cumsum(pos) - pos
    seen, span, code = np.zeros(n, dtype=np.int64), np.full(n, _W16 * _W32), np.zeros(n)
    for _ in range(3):
        code = code * _W16 + words.take(at, mode="clip")
        at += 1
    numbers = np.zeros((width, n), dtype=np.int16)
    for t in range(width):
        m = _active(lens, t)
        places = lanes.places[:m]
        lanes.look(m)
        unit = np.floor(span[:m] / lanes.total)
        target = np.minimum(np.floor(code[:m] / unit), lanes.total - 1).astype(np.float32)
        passed = np.bitwise_count((lanes.upto <= target[:, None]).view(np.uint64))
        event = (passed[:, 0] + passed[:, 1]).astype(np.int64)
        start, s = lanes.range(m, event)
        start *= unit
        rest = code[:m] - start
        s *= unit
        s *= _SHARE.take(event)
        np.floor(s, out=s)
        ranked = event >= 2
        new = event == NEW
        ranked ^= new
        plain = np.floor(rest / s)
        plain *= ranked
        rest -= plain * s
        code[:m], span[:m] = rest, s
        k = (s < _W32).nonzero()[0]
        while len(k):
            a = at.take(k)
            code[k] = code.take(k) * _W16 + words.take(a, mode="clip")
            at[k] = a + 1
            s = span.take(k) * _W16
            span[k] = s
            k = k[s < _W32]
        r = plain.astype(np.int64)
        r += _LEAST.take(event)
        np.copyto(r, seen[:m], where=new)
        np.minimum(r, width - 1, out=r)
        seen[:m] += new
        front = places + (r >> 1)
        r += places
        moved, other = lanes.list.take(r), lanes.list.take(front)
        lanes.list[r] = other
        lanes.list[front] = moved
        ids16 = numbers[t, :m]
        ids16[:] = moved
        np.copyto(ids16, lanes.g1, where=event == HIT1)
        np.copyto(ids16, lanes.g2, where=event == HIT2)
        lanes.learn(m, event, ids16.astype(np.int64), ids16, lanes.g2 == ids16, lanes.g1 == ids16)
    return numbers


def _packed(ids: np.ndarray, bits: int) -> bytes:
    each = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - bits :]
    return np.packbits(each).tobytes()


def _unpacked(data: np.ndarray, count: int, bits: int) -> np.ndarray:
    each = np.zeros((count, 32), dtype=np.uint8)
    each[:, 32 - bits :] = np.unpackbits(data, count=count * bits).reshape(count, bits)
    return np.packbits(each).view(">u4").astype(np.uint32)


def _units(ids: np.ndarray, stops: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Distinct units in order, the number of each unit of `ids` among them, where each starts, and ids that a unit holds."""
    n, most = len(ids), 64 // bits
    if stops is None or most == 1:
        starts, most = np.arange(n, dtype=np.int32), 1
    else:
        starts = np.append(0, np.flatnonzero(stops[:-1]) + 1).astype(np.int32)
        many = (np.diff(starts, append=np.int32(n)) + (most - 1)) // most
        if many.max() > 1:
            first = np.cumsum(many) - many
            starts = (np.repeat(starts - most * first, many) + most * np.arange(many.sum())).astype(np.int32)
    # the first id in the highest bits; no id is 0
    keys = ids.take(starts).astype(np.uint64)
    keys += np.uint64(1)
    keys <<= np.uint64(bits * (most - 1))
    lens = np.diff(starts, append=np.int32(n))
    for j in range(1, most):
        k = np.flatnonzero(lens > j)
        follows = ids.take(starts.take(k) + j).astype(np.uint64)
        follows += np.uint64(1)
        keys[k] |= follows << np.uint64(bits * (most - 1 - j))
    found = pa.array(keys).dictionary_encode()
    units = np.asarray(found.dictionary)
    if most > 1 and 2 * len(units) > len(keys):
        return _units(ids, None, bits)
    order = np.argsort(units)
    number = np.empty(len(units), dtype=np.uint32)
    number[order] = np.arange(len(units), dtype=np.uint32)
    return units[order], number.take(np.asarray(found.indices)), starts, most


def _spelled(units: np.ndarray, bits: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of units (a row each, 1 more than the id, 0 after the last), and how many each has."""
    shifts = np.arange(most - 1, -1, -1, dtype=np.uint64) * np.uint64(bits)
    fields = ((units[:, None] >> shifts) & np.uint64((1 << bits) - 1)).astype(np.uint32)
    return fields, (fields > 0).sum(axis=1)


def _write_units(units: np.ndarray, bits: int, most: int) -> bytes:
    fields, lens = _spelled(units, bits, most)
    first, low = fields[:, 0], max(0, bits - len(units).bit_length())
    ones = np.zeros((int(first[-1]) >> low) + len(units), dtype=np.uint8)
    ones[(first >> np.uint32(low)) + np.arange(len(units))] = 1
    rest = fields[:, 1:]
    return np.packbits(ones).tobytes() + _packed(first, low) + _packed(lens - 1, most.bit_length()) + _packed(rest[rest > 0], bits)


def _read_units(data: np.ndarray, count: int, bits: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids of units one after another, and how many each has."""
    at = np.flatnonzero(np.cumsum(np.bitwise_count(data), dtype=np.int64) >= count)
    if not len(at):
        raise ValueError("broken units of a segment")
    at = int(at[0]) + 1
    first = np.flatnonzero(np.unpackbits(data[:at]))[:count] - np.arange(count)
    low = max(0, bits - count.bit_length())
    size = -(-count * low // 8)
    first = (first << low) | _unpacked(data[at : at + size], count, low)
    at += size
    size = -(-count * most.bit_length() // 8)
    lens = _unpacked(data[at : at + size], count, most.bit_length()).astype(np.int64) + 1
    begin = np.cumsum(lens) - lens
    ids = np.zeros(int(lens.sum()), dtype=np.uint32)
    inner = np.ones(len(ids), dtype=bool)
    inner[begin] = False
    ids[begin] = first
    ids[inner] = _unpacked(data[at + size :], len(ids) - count, bits)
    return ids - np.uint32(1), lens


def encode(ids: np.ndarray, stops: np.ndarray | None = None, block: int = BLOCK) -> bytes:
    """A segment of ids (below 2^32 - 1); `stops` marks ids that end a unit (none given: every id is one)."""
    n = len(ids)
    if not n:
        return HEADER.pack(MAGIC, VERSION, 0, 0, block, 0)
    little = np.ascontiguousarray(ids, dtype="<u4")
    id_bits = (int(little.max()) + 1).bit_length()
    units, coded, starts, most = _units(little, stops, id_bits)
    width = min(block, len(coded))
    count = -(-len(coded) // width)
    lens = np.full(count, width)
    lens[-1] = len(coded) - width * (count - 1)
    borders = np.append(starts[::width], n)
    crcs = np.array([zlib.crc32(little[a:b]) for a, b in zip(borders[:-1], borders[1:], strict=True)], dtype="<u4")
    bits = max(1, (len(units) - 1).bit_length())
    n_units = len(coded)
    # the rest of the last block is filled with its last unit, which is not new there
    blocks = np.append(coded, np.full(count * width - n_units, coded[-1])).reshape(count, width)
    del starts, coded
    numbers, news = np.empty((width, count), dtype=np.int16), np.empty((width, count), dtype=bool)
    fresh, many = [], []
    for i in range(0, count, CHUNK):
        part = blocks[i : i + CHUNK]
        number, new = _numbered(part, bits)
        numbers[:, i : i + CHUNK], news[:, i : i + CHUNK] = number.T, new.T
        fresh.append(part[new])
        many.append(new.sum(axis=1))
    del blocks
    words, pos = _encode(numbers, news, lens)
    head = HEADER.pack(MAGIC, VERSION, bits, n, width, count) + MORE.pack(n_units, len(units), id_bits, most)
    heads = pos.astype("<u4").tobytes() + np.concatenate(many).astype("<u4").tobytes() + crcs.tobytes()
    return head + heads + words.tobytes() + _packed(np.concatenate(fresh), bits) + _write_units(units, id_bits, most)


def decode(data: bytes) -> np.ndarray:
    """The ids of a segment, of version 1 too; every block is held against its checksum."""
    magic, version, bits, n, width, count = HEADER.unpack_from(data)
    if magic == MAGIC and version == 1:
        return range_coder.decode(data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a segment of token ids")
    if not n:
        return np.zeros(0, dtype=np.uint32)
    n_units, distinct, id_bits, most = MORE.unpack_from(data, HEADER.size)
    at = HEADER.size + MORE.size
    pos, many, crcs = np.frombuffer(data, dtype="<u4", count=3 * count, offset=at).reshape(3, count).astype(np.int64)
    at += 12 * count
    words = np.frombuffer(data, dtype="<u2", count=int(pos.sum()), offset=at)
    at += 2 * len(words)
    size = -(-int(many.sum()) * bits // 8)
    fresh = _unpacked(np.frombuffer(data, dtype=np.uint8, count=size, offset=at), int(many.sum()), bits)
    ids, unit_lens = _read_units(np.frombuffer(data, dtype=np.uint8, offset=at + size), distinct, id_bits, most)
    begins = np.cumsum(unit_lens) - unit_lens
    lens = np.full(count, width)
    lens[-1] = n_units - width * (count - 1)
    numbers, begin = _decode(words, pos, lens, width), np.cumsum(many) - many
    out, done = np.empty(n, dtype=np.uint32), 0
    for i in range(0, count, CHUNK):
        part = numbers[:, i : i + CHUNK].T.astype(np.int64)
        part += begin[i : i + CHUNK, None]
        part = fresh.take(part.reshape(-1)[: int(lens[i : i + CHUNK].sum())], mode="clip")
        part = np.minimum(part, distinct - 1)
        spans = unit_lens.take(part)
        found = ids.take(gather(begins.take(part), spans))
        borders = np.append(0, np.cumsum(spans))[np.append(0, np.cumsum(lens[i : i + CHUNK]))]
        for k, (a, b) in enumerate(zip(borders[:-1], borders[1:], strict=True)):
            if zlib.crc32(found[a:b]) != crcs[i + k]:
                raise ValueError(f"block {i + k} of a segment fails its checksum")
        if done + len(found) > n:
            raise ValueError("a segment has more ids than its header says")
        out[done : done + len(found)] = found
        done += len(found)
    if done != n:
        raise ValueError("a segment has less ids than its header says")
    return out
