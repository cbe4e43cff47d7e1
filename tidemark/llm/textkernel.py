"""Vectorised text helpers that work on the byte buffers of Arrow string columns.

They run inside tasks on a few megabytes at a time: one slice of an Arrow batch holds whole texts, at most
``SLICE_BYTES`` together unless a single text is longer.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
#: Rows from which on a group is worth the call that gives memory back.
TIDY_ROWS = 256


def give_back() -> None:
    """Return freed memory to the system, where the C library and Arrow can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable) -> Callable:
    """A task's function over batches, after which its worker gives back what it no longer needs.

    Spark keeps workers for later tasks, more of them than an executor has cores, and each would hold on to the most
    that any of its tasks took.
    """

    @wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def tidy_group(run: Callable) -> Callable:
    """A function over a group's frame, after which its worker gives back what a group of some size took."""

    @wraps(run)
    def tidied(group):
        try:
            return run(group)
        finally:
            if len(group) >= TIDY_ROWS:
                give_back()

    return tidied


class Slice(NamedTuple):
    """Texts ``first`` to ``first + len(offsets) - 1`` of a batch; text i is data[offsets[i]:offsets[i + 1]]."""

    first: int
    data: np.ndarray
    offsets: np.ndarray


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column into runs of whole texts; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    raw = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    lengths = np.diff(raw)
    if column.null_count:
        lengths = np.where(np.asarray(column.is_valid()), lengths, 0)
    at = 0
    while at < n:
        total = np.cumsum(lengths[at : at + 65536])
        take = max(1, int(np.searchsorted(total, limit, side="right")))
        own = lengths[at : at + take]
        offsets = np.zeros(take + 1, np.int64)
        np.cumsum(own, out=offsets[1:])
        if int(raw[at + take] - raw[at]) == int(offsets[-1]):
            piece = data[raw[at] : raw[at + take]]
        else:  # bytes under a null
            piece = np.concatenate([data[raw[i] : raw[i] + lengths[i]] for i in range(at, at + take)] or [data[:0]])
        yield Slice(at, piece, offsets)
        at += take


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return data + ((data - np.uint8(65) < 26).astype(np.uint8) << 5)


def is_space(data: np.ndarray) -> np.ndarray:
    """Bytes 0x20 and 0x09 to 0x0D."""
    return (data == 32) | (data - np.uint8(9) < 5)


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    bounds: np.ndarray  # words of text i: bounds[i] to bounds[i + 1]


def runs(inside: np.ndarray, offsets: np.ndarray) -> Words:
    """Maximal runs of True that do not cross a text's ends."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(len(offsets), np.int64))
    head, tail = inside.copy(), inside.copy()
    head[1:] &= ~inside[:-1]
    tail[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(inside))]
    head[cuts] = inside[cuts]
    tail[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    bounds = np.searchsorted(start, offsets)
    return Words(start, end, np.repeat(np.arange(len(offsets) - 1), np.diff(bounds)), bounds)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_LANES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_SIZE = np.uint64(0xD6E8FEB86659FD93)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, limit: int = SLICE_BYTES, lane: int = 0) -> np.ndarray:
    """64-bit hashes of data[start:end] for ordered, disjoint, non-empty spans; each ``lane`` is another function.

    Eight bytes at a time are mixed with their place before they are added up, so that nothing about the sum is linear
    in the bytes; spans of one size of at most eight bytes never share a hash.
    """
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(end, start[at] + limit, side="right")))
        s, e = start[at:stop], end[at:stop]
        size = e - s
        parts = (size + 7) >> 3
        first = np.cumsum(parts) - parts
        place = np.arange(int(first[-1] + parts[-1])) - np.repeat(first, parts)
        body = np.concatenate([data[s[0] : e[-1]], np.zeros(8, np.uint8)])
        value = np.ndarray((len(body) - 7,), "<u8", body, strides=(1,))[np.repeat(s - s[0], parts) + 8 * place].astype(np.uint64)
        left = np.repeat(size, parts) - 8 * place
        value &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (np.uint64(8) - np.minimum(left, 8).astype(np.uint64)))
        value = mix(mix(value ^ mix(place.astype(np.uint64) * _LANES[lane] + _LANES[1 - lane])) * _LANES[lane])
        out[at:stop] = mix(np.add.reduceat(value, first) + size.astype(np.uint64) * _SIZE)
        at = stop
    return out


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Two lanes, 128 bits, of each span's hash."""
    return np.stack([hash_spans(data, start, end, lane=k) for k in range(2)])


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of each text, from both lanes of ``word_hashes``, and the bounds of each text's shingles.

    A text of fewer than k words has one shingle, its whole sequence; one without words has none.
    """
    n = np.diff(bounds)
    out_n = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_bounds = np.concatenate([[0], np.cumsum(out_n)])
    first = np.repeat(bounds[:-1] - out_bounds[:-1], out_n) + np.arange(out_bounds[-1])
    width = np.repeat(np.minimum(n, k), out_n)
    value = mix(width.astype(np.uint64) * _SIZE)
    padded = np.concatenate([hashes, np.zeros((2, k), np.uint64)], 1)
    for j in range(k):  # each word's 128 bits enter the state of those before it
        step = mix(mix(value ^ padded[0, first + j]) + padded[1, first + j])
        value = np.where(width > j, step, value)
    return value, out_bounds


def word_shingle_sets(column: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """For each text the ordered distinct hashes of its k-word shingles, A-Z lower-cased."""
    for piece in slices(column):
        data = lower_ascii(piece.data)
        words = runs(~is_space(data), piece.offsets)
        values, bounds = shingles(word_hashes(data, words.start, words.end), words.bounds, k)
        for i in range(len(bounds) - 1):
            yield np.unique(values[bounds[i] : bounds[i + 1]])
