"""Text columns as numpy arrays: words, hashes and shingles of many documents at a time, without a Python object a word."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random 64-bit value for each byte, and an odd one for each place in a word.
BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
PLACE = _rng.integers(0, 2**64, 1 << 14, dtype=np.uint64) | U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words end at these six bytes only.
WORD = np.ones(256, dtype=bool)
WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
SLICE = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def trim() -> None:
    """Gives freed memory back to the system: workers live on between tasks, and an executor has several."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not this C library


#: What empties the memos that operators keep in a worker between tasks.
MEMOS: list[Callable[[], None]] = []


def alone() -> None:
    """Called by operators that need the worker's memory: other operators' memos go."""
    for empty in MEMOS:
        empty()
    trim()


_seen = 0


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets of its documents) for runs of rows of about ``most`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offs = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi
    global _seen
    _seen += len(data)
    if _seen > 32 << 20:
        _seen = 0
        trim()


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray = WORD, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (byte places) of each word of a slice, and where each document's words begin (one more at the end)."""
    b = LOWER[data] if fold else data
    n = len(b)
    if n == 0:
        e = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), e, e, np.zeros(len(offs), np.int64)
    w = table[b]
    prev = np.empty(n, bool)
    prev[0] = False
    prev[1:] = w[:-1]
    edges = offs[:-1]
    prev[edges[edges < n]] = False
    starts = np.flatnonzero(w & ~prev)
    nxt = np.empty(n, bool)
    nxt[-1] = False
    nxt[:-1] = w[1:]
    ends = offs[1:]
    nxt[ends[ends > 0] - 1] = False
    ends = np.flatnonzero(w & ~nxt) + 1
    if not len(starts):
        e = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), e, e, np.zeros(len(offs), np.int64)
    size = ends - starts
    inside = b[w]
    first = np.cumsum(size) - size
    place = np.arange(len(inside), dtype=np.int64) - np.repeat(first, size)
    if place.max() >= len(PLACE):
        place &= len(PLACE) - 1
    h = np.add.reduceat(BYTE[inside] * PLACE[place], first)
    h = mix(h + size.astype(np.uint64) * U(0x9E3779B97F4A7C15))
    return h, starts, ends, np.searchsorted(starts, offs)


def unspaced(s: np.ndarray) -> np.ndarray:
    """First bytes of characters of scripts that put no spaces between words: Han, kana, Thai, Lao, Burmese, Khmer, full-width forms, signs."""
    at = np.flatnonzero(s[:-2] >= 0xE0) if len(s) > 2 else np.zeros(0, np.int64)
    lead, second = s[at], s[at + 1]
    use = (lead >= 0xE3) & (lead <= 0xE9) | (lead >= 0xEF) | (lead == 0xE0) & (second >= 0xB8) & (second <= 0xBB)
    return at[use | (lead == 0xE1) & ((second >= 0x80) & (second <= 0x82) | (second >= 0x9E) & (second <= 0x9F))]


def units(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``words`` of letters and digits, but that each character of a script without spaces is a word of its own."""
    s = LOWER[data]
    at = unspaced(s)
    if not len(at):
        return words(s, offs, ALNUM, fold=False)
    size = np.where(s[at] >= 0xF0, 4, 3)
    size = np.minimum(size, len(s) - at)
    other, mine = s.copy(), np.zeros(len(at), np.uint64)
    for k in range(4):
        on = size > k
        mine[on] += BYTE[s[at[on] + k]] * PLACE[k]
        other[at[on] + k] = 32
    h, starts, ends, _ = words(other, offs, ALNUM, fold=False)
    h = np.concatenate((h, mix(mine + size.astype(np.uint64) * U(0x9E3779B97F4A7C15))))
    starts, ends = np.concatenate((starts, at)), np.concatenate((ends, at + size))
    order = np.argsort(starts, kind="stable")
    return h[order], starts[order], ends[order], np.searchsorted(starts[order], offs)


STEP = _rng.integers(0, 2**64, 64, dtype=np.uint64) | U(1)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of ``n`` word hashes; runs may cross documents, so callers take those inside only."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1] * STEP[0]
    for j in range(1, n):
        out = out + h[j : len(h) - n + 1 + j] * STEP[j]
    return mix(out + U(n))


def shingles(h: np.ndarray, bounds: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Each document's sorted distinct shingles: runs of ``n`` words, the whole sequence if shorter, none without words."""
    g = grams(h, n)
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        k = hi - lo
        if k >= n:
            s = np.sort(g[lo : hi - n + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif k:
            yield mix((h[lo:hi] * STEP[:k]).sum(dtype=np.uint64, keepdims=True) + U(k))
        else:
            yield h[:0]


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
