"""Vectorised text kernels shared by the llm operators.

Everything here works on plain bytes and numpy arrays, one bounded slice of a
batch at a time, so that a worker's memory follows ``SLICE_BYTES`` and the
longest single text, not the size of an Arrow batch.

Words are the maximal runs of ``[^\\x20\\x09-\\x0D]`` of the UTF-8 text, which
is what ``bytes.split()`` returns. Hashes are 64 bits wide, in two families
that know nothing of each other. No hash is a polynomial, so there is no
pattern of bytes, words or lines that makes it collide: blocks of eight bytes
are mixed with their place before they are added up, and sequences are hashed
as mixed pairs of shorter ones.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 500_000
U = np.uint64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_ODD = U(0x9E3779B97F4A7C15)
#: What sets the two families of hashes apart.
_FAMILY = (U(0x243F6A8885A308D3), U(0x452821E638D01377))
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False, family: int = 0) -> np.ndarray:
    """A hash of the bytes of each range; ``lower`` folds A-Z.

    Ranges of one length up to eight bytes never collide.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = _LOWER[data] if lower else data
    eight = np.ascontiguousarray(np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,)))
    size = (end - start).astype(np.int64)
    salt = _FAMILY[family]
    total = mix((eight[start] & _MASK[np.minimum(size, 8)]) + salt)
    place, live = 8, np.flatnonzero(size > 8)
    if len(live) and size.max() <= 512:
        while len(live):
            total[live] += mix((eight[start[live] + place] & _MASK[np.minimum(size[live] - place, 8)]) + mix(np.full(1, salt + U(place))))
            place += 8
            live = live[size[live] > place]
    elif len(live):
        more = (size[live] - 1) >> 3
        owner = np.repeat(np.arange(len(live)), more)
        first = np.cumsum(more) - more
        at = (np.arange(len(owner)) - first[owner] + 1) << 3
        part = mix((eight[start[live][owner] + at] & _MASK[np.minimum(size[live][owner] - at, 8)]) + mix(salt + at.astype(np.uint64)))
        total[live] += np.add.reduceat(part, first)
    return mix(total + size.astype(np.uint64) * _ODD)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, row offsets) of a text column.

    Nulls are empty. A slice holds whole rows; only a single row that is longer
    than ``limit`` makes a slice longer than it.
    """
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    column = column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"")
    wide = np.int64 if kind == pa.large_binary() else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
        yield first, last, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a worker process lives on, and the next stage runs beside what it holds."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


class Words:
    """Words of a slice: ``start``, ``end`` (bytes), ``row`` and ``first`` (row -> first word)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        rows = len(offsets) - 1
        inside = ~_SPACE[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cut = offsets[:-1][(offsets[:-1] < len(data)) & (offsets[:-1] < offsets[1:])]
        begins[cut] = inside[cut]
        self.start = np.flatnonzero(begins)
        stops = inside.copy()
        stops[:-1] &= ~inside[1:]
        last = cut[cut > 0] - 1
        stops[last] = inside[last]
        self.end = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(rows), self.count)
        self.data, self.offsets = data, offsets

    def hashes(self, lower: bool = False, family: int = 0) -> np.ndarray:
        """A hash for each word; ``lower`` folds A-Z."""
        return ranges(self.data, self.start, self.end, lower, family)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _ODD + b)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive values: two halves that overlap unless k is a power of two, and so on down."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    span, out = 1, hashes
    while 2 * span <= k:
        out = _pair(out[:-span], out[span:])
        span *= 2
    return mix(_pair(out[:n], out[k - span : k - span + n]) + U(k))


def sequences(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the values of each range, equal to that of :func:`windows` for its length."""
    size = end - start
    out = np.zeros(len(start), np.uint64)
    span, level, longest = 1, hashes, int(size.max(initial=0))
    while span <= longest:
        own = np.flatnonzero((size >= span) & (size < 2 * span))
        out[own] = mix(_pair(level[start[own]], level[end[own] - span]) + size[own].astype(np.uint64))
        if 2 * span <= longest:
            level = _pair(level[:-span], level[span:])
        span *= 2
    return out


def within(words: Words, k: int) -> np.ndarray:
    """Which word positions start k words of one row."""
    n = len(words.row) - k + 1
    return words.row[:n] == words.row[k - 1 :] if n > 0 else np.zeros(0, bool)


def shingle_sets(words: Words, k: int, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row offsets, hashes): the distinct k-word shingles of each row, sorted.

    A row of fewer than k words, but at least one, has its whole sequence as
    its one shingle; a row without words has the empty set.
    """
    base = words.hashes(lower=True, family=family)
    ok = within(words, k)
    grams, owner = windows(base, k)[ok], words.row[: len(ok)][ok]
    rows = len(words.count)
    ends = np.searchsorted(owner, np.arange(rows + 1))
    out, size = [], np.zeros(rows + 1, np.int64)
    for r in range(rows):
        n = int(words.count[r])
        if n >= k:
            part = np.unique(grams[ends[r] : ends[r + 1]])
        elif n:
            part = windows(base[words.first[r] : words.first[r + 1]], n)
        else:
            part = grams[:0]
        out.append(part)
        size[r + 1] = len(part)
    return np.cumsum(size), np.concatenate(out) if out else grams[:0]


def superminhash(offsets: np.ndarray, items: np.ndarray, m: int) -> np.ndarray:
    """Signatures (rows x m) of sets given as flat hashes with row offsets.

    Level by level, each element of a row takes the next slot of its own random
    permutation of the m slots, with rank ``level + random``; a slot keeps its
    least rank. The levels of one element never meet in a slot, which is what
    makes the estimate's variance lower than that of independent hashes. A row
    is done as soon as each of its slots is taken: later levels only have
    greater ranks. Rows without elements keep the greatest value.
    """
    rows = len(offsets) - 1
    full = np.iinfo(np.uint64).max
    sig = np.full(rows * m, full, np.uint64)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    perm = None
    for level in range(m):
        if not len(items):
            break
        draw = mix(items + U((level + 1) * 0xD1B54A32D192ED03 % 2**64))
        pick = level + ((draw >> U(40)) % U(m - level)).astype(np.int64)
        if level == 0:
            slot = pick
        else:
            lines = np.arange(len(items))
            slot = perm[lines, pick].astype(np.int64)
            perm[lines, pick] = perm[:, level]
        np.minimum.at(sig, row * m + slot, (U(level) << U(40)) | (draw & U((1 << 40) - 1)))
        open_rows = (sig.reshape(rows, m) == full).any(axis=1)
        keep = open_rows[row]
        if level == 0:
            items, row, pick = items[keep], row[keep], pick[keep]
            perm = np.tile(np.arange(m, dtype=np.uint16 if m > 256 else np.uint8), (len(items), 1))
            perm[np.arange(len(items)), pick] = 0
        elif not keep.all():
            items, row, perm = items[keep], row[keep], perm[keep]
    return sig.reshape(rows, m)
