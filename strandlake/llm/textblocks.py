"""Words of many texts at once, as numpy arrays over Arrow string buffers.

Words are maximal runs of bytes other than space and 0x09-0x0D; UTF-8 never uses
those bytes inside a longer character, so byte work equals character work.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Texts are processed in slices of about this many bytes (one text may be longer).
SLICE_BYTES = 250_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def unlike(columns: list[str], *names: str) -> list[str]:
    """``names``, each lengthened until it is like none of ``columns``, whatever the case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, giving freed memory back to the system when a task ends.

    Python workers outlive their tasks, and allocators keep what was freed: without this, every
    idle worker of an executor holds the peak of the largest task it has seen.
    """

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return wrapped


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply), elementwise."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x2545F4914F6CDD1D  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal neighbours."""
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return starts, np.r_[starts[1:], len(keys)]


class Words:
    """Word boundaries of a slice of texts. Word i of text d has first[d] <= i < first[d + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        space = _SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = edge[:-1].copy()
        before[1:] |= space[:-1]
        after = edge[1:].copy()
        after[:-1] |= space[1:]
        self.solid = ~space
        self.starts = np.flatnonzero(self.solid & before)
        self.ends = np.flatnonzero(self.solid & after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.count = np.diff(self.first)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes for features: fast, but long words can be made to collide."""
        data = LOWER[self.data] if lower else self.data
        n = len(data)
        summed = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_CODE[data] * powers(_BASE, n), out=summed[1:])
        return mix64((summed[self.ends] - summed[self.starts]) * powers(_INVERSE, n + 1)[self.starts])

    def _encoded(self, lower: bool = False) -> pa.DictionaryArray:
        """The words as a dictionary array."""
        data = (LOWER[self.data] if lower else self.data)[self.solid]
        offsets = np.r_[0, np.cumsum(self.ends - self.starts)].astype(np.int64)
        packed = [None, pa.py_buffer(offsets), pa.py_buffer(data)]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.starts), packed).dictionary_encode()

    def ids(self, lower: bool = False) -> np.ndarray:
        """A number from 0 for each word; equal words alone have equal numbers."""
        return self._encoded(lower).indices.to_numpy().astype(np.int64)

    def digests(self) -> np.ndarray:
        """The XXH64 of each word's bytes, taken once for each distinct word."""
        found = self._encoded()
        known = np.fromiter((xxhash.xxh64_intdigest(w) for w in found.dictionary.to_pylist()), np.uint64, len(found.dictionary))
        return known[found.indices.to_numpy()]

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if offsets else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return data, offsets


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets) of consecutive rows with about ``size`` bytes each."""
    data, offsets = buffers(column)
    row, rows = 0, len(column)
    while row < rows:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, to, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to


def word_grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, orders: tuple[int, ...], features: int):
    """Hashed byte n-grams of words, bounded by one space on each side, A-Z lower-cased.

    Returns the first place of each word and, for each order, the feature at each
    place (where a gram ends) with whether the gram lies within its word.
    """
    length = ends - starts + 1  # and the space that follows
    total = int(length.sum())
    begin = np.cumsum(length) - length
    place = np.arange(total) - np.repeat(begin, length)
    code = np.full(total + max(orders), 32, np.uint64)
    text = LOWER[data][np.minimum(np.repeat(starts, length) + place, max(0, len(data) - 1))]
    text[begin + length - 1] = 32
    pad = max(orders)
    code[pad:] = text
    run = code[pad:].copy()
    found = []
    for order in range(2, max(orders) + 1):
        run += code[pad - order + 1 : total + pad - order + 1] << np.uint64(8 * (order - 1))
        if order in orders:
            feature = (mix64(run + np.uint64(order << 56)) & np.uint64(features - 1)).astype(np.int64)
            found.append((feature, place >= order - 2))  # the first gram starts with the space before the word
    return begin, found
