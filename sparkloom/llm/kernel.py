"""Vectorised text kernels shared by the operators of this subpackage.

Everything works on the UTF-8 bytes of an Arrow string column, so a batch of
texts is cut into words, hashed and grouped into shingles by a handful of
numpy passes instead of a Python loop per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The white space of a word boundary, and A-Z to a-z.
_WS = np.zeros(256, bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection that spreads every input bit."""
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _BASE)


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes under a string column, and where each row begins in them (one more than rows); nothing is copied."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1] if places is not None else np.zeros(0, kind)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets if len(offsets) else np.zeros(1, kind)


def string_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, one more than rows) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    data, offsets = _buffers(column)
    offsets = offsets.astype(np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Runs of whole rows of about `limit` bytes, so that working memory follows the longest row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


_NOT_WS = ~_WS


def word_spans(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray = _NOT_WS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the runs of `letters` (else of the words `[^\\x20\\x09-\\x0D]+`), and the first of each row (one more than rows)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = letters[data]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    starts, ends = ink.copy(), ink.copy()
    starts[1:] &= ~ink[:-1]
    ends[:-1] &= ~ink[1:]
    starts[cuts] = ink[cuts]
    ends[cuts - 1] = ink[cuts - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; spans are disjoint and ascending."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    total = int(lens.sum())
    small = np.int32 if len(data) < 1 << 31 else np.int64
    within = np.arange(total, dtype=small) - np.repeat(first.astype(small), lens)
    powers = np.cumprod(np.full(int(lens.max()), _BASE, np.uint64))
    values = _BYTE[data[np.repeat(starts.astype(small), lens) + within]]
    values *= powers[within]
    return mix64(np.add.reduceat(values, first) + lens.astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the first word of each row."""
    starts, ends, first = word_spans(data, offsets)
    return span_hashes(_LOWER[data] if lower else data, starts, ends), first


_SLOT = mix64(np.arange(1, 65, dtype=np.uint64) * _M1) | _U(1)


def window_hashes(words: np.ndarray, slots: tuple[int, ...], width: int) -> np.ndarray:
    """Hash of the words at `slots` of the window of `width` words that begins at each word (shorter tail left out)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, _U(width), np.uint64)
    for s in slots:
        total += words[s : s + n] * _SLOT[s]
    return mix64(total)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Ascending distinct shingle hashes of each row: windows of `width` words, or all words of a shorter row as one."""
    words, first = word_hashes(data, offsets)
    windows = window_hashes(words, tuple(range(width)), width)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(windows[a : b - width + 1]))
        elif b > a:
            out.append(mix64((words[a:b] * _SLOT[: b - a]).sum(keepdims=True, dtype=np.uint64) + _U(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def tidy() -> None:
    """Give freed memory back to the system: workers stay for other stages, and what they hold counts against their executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def cut_rows(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batch in runs of rows with about `limit` bytes of `column`, each with that column's bytes and offsets. Runs are cut first, so no copy is larger than a run."""
    k = batch.schema.get_field_index(column)
    _, offsets = _buffers(batch.column(k))
    for i, j in row_slices(offsets, limit):
        part = batch.slice(i, j - i)
        yield part, *string_bytes(part.column(k))
    tidy()
