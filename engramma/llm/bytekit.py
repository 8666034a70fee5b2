"""Vectorised text scanning over Arrow string buffers: words, word hashes and shingle hashes in numpy.

The functions work on the UTF-8 bytes of a whole Arrow batch at once, so no Python object is made per word. Batches are
cut into pieces of a bounded number of bytes (``pieces``), which bounds the memory of a task by the longest text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes scanned at a time: some fifteen arrays of eight bytes a byte are alive in a scan.
PIECE_BYTES = 256_000

_rng = np.random.RandomState(20240229)
_BYTE = _rng.randint(0, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 2**64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("p")
    if have is None or len(have) < n:
        size = max(n, PIECE_BYTES + 1)
        for name, base in (("p", _P), ("i", _P_INV)):
            a = np.full(size, base, U)
            a[0] = 1
            _powers[name] = np.cumprod(a, dtype=U)
    return _powers["p"], _powers["i"]


def table_of(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


#: Bytes that are not white space as ``[^\x20\x09-\x0D]``.
NOT_SPACE = ~table_of(b" \t\n\x0b\x0c\r")
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_binary())
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]] if len(offs) else data[:0], offs - offs[0] if len(offs) else np.zeros(1, np.int64)


def pieces(offs: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or of one row."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        yield a, b
        a = b


def spans(data: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes for which ``inside`` holds, cut at row bounds; and the index of each row's first run."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    m = inside[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    s = m.copy()
    s[1:] &= ~m[:-1] | edge[1:n]
    e = m.copy()
    e[:-1] &= ~m[1:] | edge[1:n]
    starts = np.flatnonzero(s)
    return starts, np.flatnonzero(e) + 1, np.searchsorted(starts, offs)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    if not len(starts):
        return np.zeros(0, U)
    p, inv = _power(len(data) + 1)
    c = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * p[: len(data)], out=c[1:])
    return mix((c[ends] - c[starts]) * inv[starts] + (ends - starts).astype(U))


def shingles(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's n-word shingles, and the index of each row's first one.

    A row of fewer words has its whole sequence as its one shingle, a row without words none.
    """
    count = np.diff(first)
    k = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    at = np.zeros(len(first), np.int64)
    np.cumsum(k, out=at[1:])
    out = np.zeros(at[-1], U)
    mult = [U(pow(0xD6E8FEB86659FD93, j, 2**64)) for j in range(n)]
    if len(words) >= n:
        h = np.zeros(len(words) - n + 1, U)
        for j in range(n):
            h += words[j : len(words) - n + 1 + j] * mult[j]
        row = np.repeat(np.arange(len(count)), np.where(count >= n, count - n + 1, 0))
        pos = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(np.where(count >= n, count - n + 1, 0))[:-1]]), np.where(count >= n, count - n + 1, 0))
        out[at[row] + pos] = mix(h[first[:-1][row] + pos] + U(n))
    for c in range(1, n):
        rows = np.flatnonzero(count == c)
        if len(rows):
            h = np.zeros(len(rows), U)
            for j in range(c):
                h += words[first[rows] + j] * mult[j]
            out[at[rows]] = mix(h + U(c))
    return out, at


def _give_back() -> None:
    """Returns memory that is free in this process to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        trim = ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # not the GNU library
        return
    trim(0)


def frugal(run: Callable) -> Callable:
    """A task's function over batches that gives back what it took when it ends: workers live on between tasks, and their share counts."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return wrapped
