"""The words of many texts at once, as arrays: no Python object is made for a word."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_rng = np.random.default_rng(29)
MIX = _rng.integers(1, 1 << 63, 4, dtype=np.uint64) | np.uint64(1)
#: a random number for each byte, A-Z as a-z
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTES[65:91] = _BYTES[97:123]
_SOLID = np.array([b not in b" \t\n\x0b\x0c\r" for b in range(256)])
_BASE = int(MIX[3]) | 5
CHUNK = 1 << 20
_powers: dict[int, np.ndarray] = {}


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * MIX[0] + b * MIX[1]
    x ^= x >> np.uint64(31)
    x *= MIX[2]
    return x ^ (x >> np.uint64(29))


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0, base ** 1, ... modulo 2 ** 64: n of them at least, remembered up to twice CHUNK."""
    if len(_powers.get(base, ())) < n:
        out = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(max(n, CHUNK) - 1, base, np.uint64))), dtype=np.uint64)
        if n > 2 * CHUNK:
            return out
        _powers[base] = out
    return _powers[base]


def _hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64 bits for each word data[starts[i]:stops[i]]: a polynomial in random numbers of its bytes, from prefix sums, mixed."""
    out = np.empty(len(starts), np.uint64)
    inverse = pow(_BASE, -1, 1 << 64)
    at = 0
    while at < len(starts):  # chunk by chunk, as the sums take 8 bytes for each byte of text
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(starts, low + CHUNK)))
        high = int(stops[to - 1])
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[data[low:high]] * _power(_BASE, high - low)[: high - low], dtype=np.uint64)))
        a, b = starts[at:to] - low, stops[at:to] - low
        out[at:to] = (sums[b] - sums[a]) * _power(inverse, high - low)[a]
        at = to
    out ^= out >> np.uint64(32)
    out *= MIX[2]
    return out ^ (out >> np.uint64(29))


class Words:
    """``hashes`` of all words of a column of texts, in order; text k has the words [first[k], first[k + 1]).

    Words end at ASCII white space, A-Z count as a-z, null texts are empty. ``rids`` are the texts' own hashes.
    """

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "")
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        _, places, data = texts.buffers()
        self.edges = np.frombuffer(places, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        self.data = np.frombuffer(data or b"", np.uint8)[self.edges[0] : self.edges[-1]]
        self.edges -= self.edges[0]
        solid = _SOLID[self.data]
        fresh = np.zeros(len(solid) + 1, bool)
        fresh[self.edges] = True  # a text starts here, or the last one ends
        starts, stops = solid.copy(), solid.copy()
        starts[1:] &= ~solid[:-1] | fresh[1:-1]
        stops[:-1] &= ~solid[1:] | fresh[1:-1]
        self.starts, self.stops = np.flatnonzero(starts), np.flatnonzero(stops) + 1
        self.hashes = _hashes(self.data, self.starts, self.stops)
        self.first = np.searchsorted(self.starts, self.edges)
        raw = memoryview(self.data)
        self.rids = np.array([xxhash.xxh64_intdigest(raw[a:b]) for a, b in zip(self.edges[:-1].tolist(), self.edges[1:].tolist())], np.uint64)
        self.rids = (self.rids ^ np.uint64(1 << 63)).view(np.int64)  # in the order of the unsigned hashes

    def shingles(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on, texts run together."""
        count = max(0, len(self.hashes) - n + 1)
        return reduce(mixed, (self.hashes[k : count + k] for k in range(n)))

    def paragraphs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, number within it, first word, last word + 1) of each paragraph that has a word.

        Paragraphs are parted by blank lines; a text that has none between its words is parted at every line.
        """
        n = len(self.edges) - 1
        breaks = np.flatnonzero(self.data == 10)
        owner = np.concatenate((np.arange(n), np.searchsorted(self.edges, breaks, "right") - 1))
        order = np.argsort(owner, kind="stable")  # a text's start, then its breaks in order
        text = owner[order]
        word = np.searchsorted(self.starts, np.concatenate((self.edges[:-1], breaks + 1))[order])
        stop = np.append(word[1:], len(self.starts))
        full = stop > word
        behind = np.append(False, ~full[:-1] & (text[1:] == text[:-1]))  # the line before is blank
        inner = behind & full & (word > self.first[text])
        blank = np.zeros(n, bool)
        blank[text[inner]] = True
        head = full & (~blank[text] | behind | (word == self.first[text]))
        text, a = text[head], word[head]
        b = np.append(a[1:], len(self.starts))
        starts = np.flatnonzero(np.append(True, text[1:] != text[:-1])) if len(text) else np.zeros(0, np.int64)
        at = np.arange(len(text)) - np.repeat(starts, np.diff(np.append(starts, len(text))))
        return text, at, a, b


class Sketch:
    """A set of 64-bit hashes as bits of a table of fixed size: it holds all that were put in, and may hold others.

    The table is made in the cluster and reaches the driver as one bitmap of 4 KB for each 32768 bits.
    """

    def __init__(self, hashes: DataFrame, bits: int):
        """``hashes`` has one column of longs; ``bits`` is a power of two."""
        low = F.col(hashes.columns[0]).bitwiseAND(F.lit(bits - 1)) + 1
        parts = hashes.select(low.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m"))
        table = np.zeros(bits // 8, np.uint8)
        for r in parts.collect():  # at most bits / 32768 rows
            table[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(r.m, np.uint8)
        self.mask = np.uint64(bits - 1)
        self.held = hashes.sparkSession.sparkContext.broadcast(table.tobytes())

    def __getstate__(self) -> dict:
        return {"mask": self.mask, "held": self.held}

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        table = np.frombuffer(self.held.value, np.uint8)
        low = hashes & self.mask
        return (table[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 > 0


def name_hash(name: Column) -> Column:
    """As xxhash.xxh64_intdigest(name, 42)."""
    return F.xxhash64(name)
