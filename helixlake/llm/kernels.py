"""Vectorised text kernels over Arrow string batches (NumPy only).

All work on the UTF-8 bytes of many documents at once, so the cost per word
does not include a Python call.  Hashes are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are worked on at a time; a longer document is worked on alone.
CHUNK_BYTES = 1_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEED = np.random.RandomState(20240229)
_BYTE = _SEED.randint(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_POWER, _INVERSE = np.uint64(0xD1342543DE82EF95), None
#: Space and the controls 9 to 13.
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _tables or len(_tables["p"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("p", int(_POWER)), ("q", pow(int(_POWER), -1, 2**64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _tables[name] = np.cumprod(x)
    return _tables["p"], _tables["q"]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span; values are 64-bit words."""
    p, q = _powers(len(values) + 1)
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values * p[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(np.uint64) * _ODD)


class Texts:
    """Some documents as one byte array with offsets; nulls are empty texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def words(self, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the white-space-separated words; first word of each document; byte spans (n, 2)."""
        data = LOWER[self.data] if lower else self.data
        white = WHITE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[self.offsets] = True
        solid = ~white
        before = np.empty(len(data) + 1, bool)
        before[0], before[1:] = False, solid
        start = np.flatnonzero(solid & (~before[:-1] | edge[:-1]))
        after = np.empty(len(data), bool)
        after[:-1], after[-1:] = solid[1:], False
        end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        hashes = span_hashes(_BYTE[data], start, end)
        return hashes, np.searchsorted(start, self.offsets).astype(np.int64), np.stack([start, end], 1)


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """The column's texts, in order, in groups of about limit bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(size)])
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + limit, "right")) - 1)
        # Only this group's bytes are copied, not the batch's.
        own = pc.fill_null(column.slice(i, j - i), "").cast(pa.large_string())
        _, where, raw = own.buffers()
        offsets = np.frombuffer(where, np.int64)[own.offset : own.offset + len(own) + 1]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        yield Texts(data[offsets[0] : offsets[-1]], offsets - offsets[0], i)
        i = j


def shingles(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words that lie in one document; first shingle of each document.

    A document of fewer than n words, but some, has one shingle of all of them.
    """
    count = np.diff(first)
    many = np.where(count == 0, 0, np.maximum(count - n + 1, 1))
    at = np.concatenate([[0], np.cumsum(many)])
    start = np.repeat(first[:-1] - at[:-1], many) + np.arange(at[-1])
    end = np.minimum(start + n, np.repeat(first[1:], many))
    return span_hashes(words, start, end), at


class HashTable:
    """An immutable map from 64-bit keys to positions, with vectorised look-ups."""

    def __init__(self, keys: np.ndarray):
        keys = np.asarray(keys, np.uint64)
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        self.keys = keys
        at, rest = self._slot(keys), np.arange(len(keys), dtype=np.int32)
        while len(rest):
            free = self.slots[at] < 0
            self.slots[at[free]] = rest[free]
            lost = self.slots[at] != rest
            at, rest = (at[lost] + 1) & self.mask, rest[lost]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _ODD) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, or -1."""
        out = np.full(len(keys), -1, np.int32)
        if not len(self.keys) or not len(keys):
            return out
        at, todo = self._slot(keys), None
        while True:
            got = self.slots[at]
            want = keys if todo is None else keys[todo]
            hit = (got >= 0) & (self.keys[got] == want)
            if todo is None:
                out[hit] = got[hit]
                todo = np.flatnonzero(~hit & (got >= 0))
                at = at[todo]
            else:
                out[todo[hit]] = got[hit]
                on = ~hit & (got >= 0)
                todo, at = todo[on], at[on]
            if not len(todo):
                return out
            at = (at + 1) & self.mask
