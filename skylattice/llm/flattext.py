"""Texts of an Arrow batch as one flat byte array: word spans and hashes without a Python step per word.

All character classes used here are ASCII classes or their complement, so they can be decided byte
by byte in UTF-8. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are handled in runs of about this many bytes, which bounds a kernel's memory.
PIECE_BYTES = 2 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_WINDOW = _U(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of words: anything but white space 0x20 and 0x09-0x0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of alphanumeric words after lower-casing: 0-9, a-z and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        for_base, for_inverse = np.full(n, _BASE), np.full(n, _INVERSE)
        for_base[0] = for_inverse[0] = 1
        _powers, _inverses = np.cumprod(for_base), np.cumprod(for_inverse)
    return _powers, _inverses


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, starts - starts[0]


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a column into runs of rows of at most about ``limit`` bytes: (first row, end row, bytes, offsets).

    A longer single text is a run of its own, whole.
    """
    flat, starts = string_bytes(column)
    row, n = 0, len(starts) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(starts, starts[row] + limit, "right")) - 1)
        yield row, end, flat[starts[row] : starts[end]], starts[row : end + 1] - starts[row]
        row = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def spans(data: np.ndarray, starts: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes whose class is True, never across rows: begins, ends, and n + 1 run offsets of the rows."""
    n = len(data)
    member = inside[data]
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0], after[-1] = False, False
        before[1:], after[:-1] = member[:-1], member[1:]
        before &= ~edge[:-1]
        after &= ~edge[1:]
    begins = np.flatnonzero(member & ~before)
    ends = np.flatnonzero(member & ~after) + 1
    return begins, ends, np.searchsorted(begins, starts)


def span_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every span, from one running sum over the data."""
    powers, inverses = power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers[: len(data)], out=total[1:])
    value = (total[ends] - total[begins]) * inverses[begins]
    return mix(value + (ends - begins).astype(np.uint64) * _WINDOW)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive entries; entry i covers i .. i + size - 1, rows ignored."""
    n = max(0, len(words) - size + 1)
    value = np.zeros(n, np.uint64)
    for k in range(size):
        value = value * _WINDOW + words[k : k + n]
    return mix(value)


def ragged(offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat positions of the given rows of a ragged array, one row after the other, and their lengths."""
    lengths = offsets[rows + 1] - offsets[rows]
    ends = np.cumsum(lengths)
    positions = np.arange(ends[-1] if len(ends) else 0, dtype=np.int64)
    positions += np.repeat(offsets[rows] - (ends - lengths), lengths)
    return positions, lengths


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def strings_of(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A large-string column over flat bytes, without a copy per row."""
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
