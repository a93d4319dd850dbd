"""Vectorised numpy work on the UTF-8 bytes of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            p = np.full(max(n, 64), np.uint64(0xD6E8FEB86659FD93))
            p[0] = 1
            _POWERS = np.cumprod(p, dtype=np.uint64)
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a string or binary array; a null has no bytes."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, off, data = column.buffers()
    o = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), o


def chunks(column: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0): whole texts, about ``most`` bytes together."""
    if not len(column):
        return
    data, o = buffers(column)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(o, o[a] + most, "right")) - 1)
        yield a, b, data[o[a] : o[b]], o[a : b + 1] - o[a]
        a = b


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the maximal runs of bytes outside ``space``, none across texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~space[data]
    head, tail = word.copy(), word.copy()
    head[1:] &= ~word[:-1]
    tail[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    head[inner] = word[inner]
    tail[inner - 1] = word[inner - 1]
    starts = np.flatnonzero(head)
    return starts, np.flatnonzero(tail) + 1 - starts


def word_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes and length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    ends = np.cumsum(lengths)
    within = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
    at = within + np.repeat(starts, lengths)
    with np.errstate(over="ignore"):
        v = (data[at].astype(np.uint64) + np.uint64(1)) * _powers(int(lengths.max()))[within]
        return mix(np.add.reduceat(v, ends - lengths) + lengths.astype(np.uint64) * MULTIPLIER)


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The text in which each position lies."""
    return np.searchsorted(offsets, starts, "right") - 1


def table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


SPACE = table(b" \t\n\x0b\x0c\r")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: All but ASCII letters, digits and the bytes of other scripts.
NOT_ALNUM = ~table(bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]))


def trim() -> None:
    """Give memory that a finished task freed back to the system: Arrow's, and the C library's where it can."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
