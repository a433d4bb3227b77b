"""Vectorised words, word hashes and shingles of a run of texts, straight from Arrow's buffers.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Its 64-bit hash takes its bytes in lanes of eight and
mixes each into the whole so far, with no linear structure that patterned words could exploit; runs of words are hashed
alike from their words' hashes. Equal words hash equally on every machine and in every process. A seed gives another,
independent hash: two of them make 128 bits where a hash alone decides.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U = np.uint64
WS = np.zeros(256, bool)
WS[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Starting points of the independent hashes.
SEEDS = (U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95))
#: The low k bytes of a lane.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
#: Bytes of a word beyond which it is hashed by BLAKE2b on its own.
LONG_WORD = 512


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of what a stands for followed by what b stands for."""
    return mix((a ^ (a >> U(29))) * U(0x9FB21C651E98DF25) + b)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    size = ends - starts
    h = mix(size.astype(U) * U(0xD1342543DE82EF95) ^ SEEDS[seed])
    if not len(h):
        return h
    raw = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", buffer=raw.data, strides=(1,))
    todo, at = np.flatnonzero(size <= LONG_WORD), 0
    while len(todo):
        left = size[todo] - at
        h[todo] = join(h[todo], lanes[starts[todo] + at] & _LOW[np.minimum(left, 8)])
        todo, at = todo[left > 8], at + 8
    for i in np.flatnonzero(size > LONG_WORD):
        word = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=bytes([seed]))
        h[i] = U(int.from_bytes(word.digest(), "little"))
    return h


def hash_runs(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive ones, by doubling."""
    run, width, out, have = h, 1, None, 0
    while True:
        if k & 1:
            n = len(run) - have
            out = run if out is None else join(out[: max(0, n)], run[have:])
            have += width
        k >>= 1
        if not k:
            return out
        run = join(run[: max(0, len(run) - width)], run[width:])
        width *= 2


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a run of texts. first[d]:first[d + 1] are the words of text d."""

    def __init__(self, column: pa.Array, lower: bool = False, breaks: np.ndarray = WS):
        """breaks: which bytes separate words."""
        self.data, self.offsets = text_buffer(column)
        data, n = self.data, len(self.data)
        inside = ~breaks[data]
        edge = self.offsets[self.offsets < n]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before[edge] = False
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        last = self.offsets[self.offsets > 0] - 1
        after[last] = False
        self.inside = inside
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self._lower = lower
        self._hashes: dict[int, np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, seed: int = 0) -> np.ndarray:
        if seed not in self._hashes:
            data = LOWER[self.data] if self._lower else self.data
            self._hashes[seed] = hash_words(data, self.starts, self.ends, seed)
        return self._hashes[seed]

    @property
    def hash(self) -> np.ndarray:
        return self.hashes()

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.counts)

    def grams(self, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each k consecutive words, its first word's index), windows within one text only."""
        h = self.hashes(seed)
        m = len(h) - k + 1
        if m <= 0:
            return np.zeros(0, U), np.zeros(0, np.int64)
        doc = self.doc_of()
        ok = np.flatnonzero(doc[:m] == doc[k - 1 :])
        return hash_runs(h, k)[ok], ok

    def bytes_of(self, d: int) -> bytes:
        return self.data[self.offsets[d] : self.offsets[d + 1]].tobytes()


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of each k consecutive values."""
    m, width = x, 1
    while width * 2 <= k:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if width < k:
        m = np.minimum(m[: len(m) - (k - width)], m[k - width :])
    return m


#: A string's CRC-32 in SQL: bytes from its hex form, and the table of the reflected polynomial.
CRC_TABLE_SQL = """(select list_transform(range(256), lambda i: list_reduce(range(8),
    lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as tab)"""
CRC_SQL = """xor(list_reduce(list_transform(range(octet_length(encode({x}))),
    lambda i: cast('0x' || substr(hex(encode({x})), 2 * i + 1, 2) as bigint)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), cast(4294967295 as bigint)), 4294967295)"""
