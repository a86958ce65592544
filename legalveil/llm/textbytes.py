"""Whole texts as NumPy arrays over their UTF-8 bytes, many texts at a time.

White space and A-Z are ASCII, so words and their lower-casing are byte operations. Chunks hold
about CHUNK bytes (one text at least), which bounds the arrays made for them.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
U = np.uint64
BASE = U(0x9E3779B97F4A7C15)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def trimmed(scan: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """scan, behind which the worker gives back the memory that it no longer uses: Spark keeps idle
    workers, and what a big task freed would else stay with them."""

    def run(batches: Iterator) -> Iterator:
        yield from scan(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

    return run


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE = mixed(np.arange(1, 257, dtype=U) * BASE)  # a random value for each byte
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse, modulo 2 ** 64, for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + (CHUNK >> 1))
        inverse = U(pow(int(BASE), -1, 1 << 64))
        made = []
        for b in (BASE, inverse):
            p = np.full(size, b, U)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """S with S[i] = sum of BYTE[codes[j]] * BASE ** j for j < i."""
    s = np.empty(len(codes) + 1, U)
    s[0] = 0
    np.cumsum(BYTE[codes] * powers(len(codes))[0], out=s[1:])
    return s


def span_hash(s: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever the span stands."""
    return mixed((s[ends] - s[starts]) * powers(len(s))[1][starts] + (ends - starts).astype(U))


def text_chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of texts; a null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if len(column) else column
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null(b"")
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): word k of text d is at first[d] + k."""
    inside = ~IS_SPACE[buf]
    before = np.zeros(len(buf), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(buf), bool)
    after[:-1] = inside[1:]
    full = off[1:] > off[:-1]
    before[off[:-1][full]] = False
    after[off[1:][full] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def run_index(first: np.ndarray) -> np.ndarray:
    """The text of each item, from the offsets of the texts' items."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sorted_distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of each run sorted and without repeats, and their offsets."""
    values = values.copy()
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a > 1:
            values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    keep[first[:-1][first[:-1] < len(values)]] = True
    count = np.concatenate(([0], np.cumsum(keep)))
    return values[keep], count[first]
