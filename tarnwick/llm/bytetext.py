"""Vectorised views of Arrow text: bytes, words and word hashes of a batch without a Python object per word."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Rows of a piece; operators pack a row's number into 16 bits.
PIECE_ROWS = 1 << 16
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) | U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    return (data[offsets[0] : offsets[-1]], offsets - offsets[0]) if n else (data[:0], np.zeros(1, np.int64))


def give_back() -> None:
    """Return freed memory to the system, for workers are reused and what they keep counts against the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, with freed memory given back when a task's rows end."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return wrapped


def pieces(table: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose text bytes stay near the limit and whose rows are PIECE_ROWS at most; a longer text stands alone."""
    _, offsets = text_bytes(table.column(column))
    at, n = 0, len(offsets) - 1
    while at < n:
        end = min(at + PIECE_ROWS, max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1))
        yield table.slice(at, end - at)
        at = end


def powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.empty(n, dtype=U64)
    if n:
        with np.errstate(over="ignore"):
            out[0] = 1
            have = 1
            while have < n:
                step = min(have, n - have)
                out[have : have + step] = out[:step] * out[have - 1] * base
                have += step
    return out


class Rolling:
    """64-bit hashes of any substrings of a byte array, from prefix sums."""

    def __init__(self, data: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(data) + 1, dtype=U64)
            np.cumsum(_BYTE[data] * powers(len(data), _BASE), dtype=U64, out=self.sums[1:])
            self.inverse = powers(len(data) + 1, _INVERSE)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            raw = (self.sums[end] - self.sums[start]) * self.inverse[start]
            return mix(raw ^ (np.asarray(end - start).astype(U64) * U64(0xD6E8FEB86659FD93)))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word [^\\x20\\x09-\\x0D]+ ; rows end words."""
    if not len(data):
        e = np.empty(0, np.int64)
        return e, e, e
    black = ~_WHITE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    first = black & (np.concatenate(([True], ~black[:-1])) | edge[:-1])
    last = black & (np.concatenate((~black[1:], [True])) | edge[1:])
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of words; the byte array should hold no more than some tens of MB."""
    return Rolling(data).of(start, end)


def spans_of(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], flag.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
