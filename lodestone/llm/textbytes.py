"""Texts of an Arrow batch as one run of UTF-8 bytes, and hashes of their words, in NumPy.

The tasks of several operators read texts this way: no Python object is made for a character or a
word. A batch is looked at in slices of bounded bytes; a longer text is a slice of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 18
#: White space of the word pattern [^\x20\x09-\x0D]+
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(MULTIPLIER, -1, 1 << 64)
_BYTE_VALUE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: dict[int, np.ndarray] = {}


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # not every C library has it
    _trim = None


def let_go() -> None:
    """Give back memory that is not in use: workers wait between tasks, and all of them share an executor's memory."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: run, and memory given back at its end."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            let_go()

    return outer


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column with nulls as empty texts, in one chunk."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the n + 1 offsets of the rows in them."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = text_array(column)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) with at most `most` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, ends = bytes_of(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
            yield batch.slice(at, to - at), data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
            at = to


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i under n at least."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE + 1), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _POWERS[base] = have
    return have


def running_sum(data: np.ndarray) -> np.ndarray:
    """Sums of byte values times powers of the multiplier over every prefix, modulo 2 ** 64."""
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE_VALUE[data] * powers(MULTIPLIER, len(data) + 1)[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes in [start, end): equal bytes, equal hashes, wherever they stand."""
    return mix((sums[ends] - sums[starts]) * powers(_INVERSE, len(sums))[starts])


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes marked in `inside`, and each row's first word (n + 1 entries)."""
    if not len(data):
        nothing = np.zeros(0, np.int64)
        return nothing, nothing, np.zeros(len(offsets), np.int64)
    cut = np.zeros(len(data), bool)
    cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:] & ~cut[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hash(word: str | bytes) -> int:
    data = np.frombuffer(word.encode() if isinstance(word, str) else word, np.uint8)
    return int(span_hashes(running_sum(data), np.array([0]), np.array([len(data)]))[0])
