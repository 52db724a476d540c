"""Vectorised work on batches of UTF-8 texts.

A batch of texts is one ``uint8`` buffer plus ``n + 1`` offsets, as Arrow keeps
it. Hashes of any span come from one prefix sum: with odd ``B`` and a random
64-bit value per byte, ``P[i] = sum(T[b[j]] * B**j)`` modulo 2**64 and
``(P[e] - P[s]) * B**-s`` depends on the span's bytes only.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_GROW = 1 << 16


def tidy(run):
    """``run`` over the batches of a task, after which the worker gives back what it holds:
    the powers that a long document needed, Arrow's spare memory and the C library's. The
    same worker serves later tasks, beside an executor that needs the room."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        for powers in BASES.values():
            powers.forget()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # C libraries without it
            ctypes.CDLL(None).malloc_trim(0)

    return whole


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (xor-shift and multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def byte_table(seed: int) -> np.ndarray:
    """256 pseudo-random odd-free 64-bit values that stand for the byte values."""
    return mix64(np.arange(256, dtype=U64) * U64(0xD1342543DE82EF95) + U64((seed + 1) * _BASE % (1 << 64)))


class Powers:
    """``B**i`` and ``B**-i`` modulo 2**64, grown on demand and kept by a worker."""

    def __init__(self, base: int = _BASE) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = np.ones(1, U64)
        self.down = np.ones(1, U64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), _GROW)
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, U64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


    def forget(self) -> None:
        """Keeps the first powers only."""
        self.up, self.down = self.up[:_GROW].copy(), self.down[:_GROW].copy()


POWERS = Powers()
#: Hash functions that are independent of each other: base and byte values.
BASES = {0: POWERS, 1: Powers(0xD1342543DE82EF95)}
TABLES = {0: byte_table(0), 1: byte_table(1)}


def prefix_sums(values: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums ``P`` of a sequence of 64-bit symbols, one longer than it."""
    up, _ = BASES[which].to(len(values) + 1)
    out = np.empty(len(values) + 1, U64)
    out[0] = 0
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def prefix_hash(buf: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums of bytes."""
    return prefix_sums(TABLES[which][buf], which)


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of the spans ``[start, end)``; equal symbols give equal hashes."""
    _, down = BASES[which].to(len(prefix))
    return mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string or binary array; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes; a longer text is a range by itself."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True


def fold_case(buf: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and the Latin-1 letters that UTF-8 writes after C3."""
    out = _FOLD[buf]
    if len(buf) > 1:
        second = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)) + 1
        out[second] += 32
    return out


#: Everything but ASCII white space.
_INK = np.ones(256, bool)
_INK[9:14] = _INK[32] = False


def words(buf: np.ndarray, offsets: np.ndarray, longest: int = 0, kind: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the words (runs of ASCII letters, digits and
    bytes over 127, or of the bytes of another ``kind``). No word crosses two texts. With ``longest``, longer runs are
    cut into pieces of that many bytes."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = kind[buf]
    first = inside[1:-1] & ~inside[:-2]
    edge = offsets[1:-1]
    edge = edge[edge < n]
    first[edge] |= inside[1:-1][edge]
    last = inside[1:-1] & ~inside[2:]
    cut = edge[edge > 0] - 1
    last[cut] |= inside[1:-1][cut]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if longest and len(start) and (end - start).max() > longest:
        pieces = (end - start + longest - 1) // longest
        which = np.repeat(np.arange(len(start)), pieces)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = start[which] + nth * longest
        end = np.minimum(start + longest, end[which])
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def inked(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the runs of anything but white space."""
    return words(buf, offsets, kind=_INK)


class HashIndex:
    """Row numbers of distinct 64-bit keys: open addressing, all in numpy.

    ``keys`` may be exact values or hashes; they are mixed before they choose a slot.
    """

    def __init__(self, keys: np.ndarray, load: float = 0.3) -> None:
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) / load))))
        size = 1 << self.bits
        self.keys = np.zeros(size, U64)
        self.rows = np.full(size, -1, np.int32)
        slot = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            _, first = np.unique(slot[left], return_index=True)
            first = left[first]
            free = first[self.rows[slot[first]] < 0]
            self.keys[slot[free]] = keys[free]
            self.rows[slot[free]] = free
            done = np.zeros(len(keys), bool)
            done[free] = True
            left = left[~done[left]]
            slot[left] = (slot[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        slot = self._slot(keys)
        out = self.rows[slot]
        active = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(active):
            slot_ = (slot[active] + 1) & (len(self.rows) - 1)
            slot[active] = slot_
            row = self.rows[slot_]
            out[active] = row
            active = active[(row >= 0) & (self.keys[slot_] != keys[active])]
        return out
