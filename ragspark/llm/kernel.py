"""Vectorised text kernels shared by the Arrow-based operators.

Everything works on the UTF-8 bytes of an Arrow batch, so no Python string is built per word:
a batch is cut into chunks of a few MB of text, words are found with a byte table, and words,
shingles and windows are hashed to 64 bits with numpy.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_M1, _M2, _M3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)

#: True for bytes that separate words: space and \x09-\x0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

#: True for bytes that separate benchmark words: all ASCII but digits and lower-case letters.
NON_WORD = np.zeros(256, bool)
NON_WORD[:0x80] = True
NON_WORD[0x30:0x3A] = False
NON_WORD[0x61:0x7B] = False

#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

CHUNK = 4 << 20


def release() -> None:
    """Gives memory that a task no longer needs back to the system: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * _M2
    x = (x ^ (x >> U64(27))) * _M3
    return x ^ (x >> U64(31))


def as_bytes(array: pa.Array) -> pa.Array:
    """A string or binary array as large binary, nulls empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_binary())
    return array.fill_null(b"") if array.null_count else array


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large binary array; the first offset is 0."""
    _, off, data = array.buffers()
    off = np.frombuffer(off, np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) with at most ``limit`` bytes of text each, or one row alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = as_bytes(batch.column(batch.schema.get_field_index(column)))
        data, off = raw(texts)
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(off, off[first] + limit, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first), data[off[first] : off[last]], off[first : last + 1] - off[first]
            first = last
    release()


def words(data: np.ndarray, off: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the index of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~separators[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number, zeros beyond the end."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 8,), "<u8", padded, strides=(1,))


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range."""
    view, size = lanes(data), (ends - starts).astype(np.int64)
    out = size.astype(U64) * _M1
    todo, at = None, 0
    while True:
        todo = np.arange(len(size)) if todo is None else todo[size[todo] > at]
        if not len(todo):
            return mix(out)
        rest = size[todo] - at
        got = view[starts[todo] + at]
        short = rest < 8
        got[short] &= (U64(1) << (rest[short].astype(U64) * U64(8))) - U64(1)
        x = (out[todo] ^ got) * _M2
        out[todo] = (x ^ (x >> U64(29))) * _M1
        at += 8


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every ``k`` consecutive hashes, whatever text they belong to."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _M1
        out += hashes[j : j + n]
        out ^= out >> U64(32)
    return mix(out)


def inside_text(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """For the ``n`` windows of ``k`` words: whether the window lies within one text."""
    ok = np.ones(max(n, 0), bool)
    for back in range(1, k):
        at = first[1:-1] - back
        at = at[(at >= 0) & (at < n)]
        ok[at] = False
    return ok


def cover(hit: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of ``n`` places lie in one of the windows of ``k`` places that start at ``hit``."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, hit, 1)
    np.add.at(delta, np.minimum(hit + k, n), -1)
    return np.cumsum(delta[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def many(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists of the given sizes laid end to end: the list and the place in it of every element."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
