"""Vectorised word and character hashing over Arrow string columns.

A column's UTF-8 buffer is scanned once with numpy: words become 64-bit hashes
without a Python object per word.  All helpers are pure functions of the bytes,
so a re-run task gives the same values.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser: spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _multipliers(n: int) -> np.ndarray:
    """An unrelated 64-bit number for each place in a word.  Sums of bytes times these are universal hashes; powers of
    one number are not: words of Thue-Morse order would cancel."""
    return mix64((np.arange(n, dtype=np.uint64) + np.uint64(1)) * _P)


class Words:
    """Word hashes of a run of texts: ``hash``, ``start`` (byte), ``length`` and ``first``,
    where words of text i are ``first[i]:first[i + 1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separator: np.ndarray):
        n = len(offsets) - 1
        base = int(offsets[0])
        text = LOWER[data[base : int(offsets[-1])]]
        edges = (offsets - base).astype(np.int64)
        inside = ~separator[text]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        at_edge = edges[:-1][edges[:-1] < len(text)]
        begins[at_edge] = inside[at_edge]
        self.start = np.flatnonzero(begins)
        at = np.flatnonzero(inside)
        first = np.searchsorted(at, self.start)
        if len(self.start):
            self.length = np.diff(first, append=len(at))
            within = np.arange(len(at)) - np.repeat(first, self.length)
            terms = (text[at].astype(np.uint64) + np.uint64(1)) * _multipliers(int(self.length.max()))[within]
            self.hash = mix64(np.add.reduceat(terms, first) + self.length.astype(np.uint64))
        else:
            self.length = np.zeros(0, dtype=np.int64)
            self.hash = np.zeros(0, dtype=np.uint64)
        self.first = np.searchsorted(self.start, edges)
        self.text = text
        self.inside = inside
        self.n = n

    def array(self) -> pa.Array:
        """The words themselves, lower-cased."""
        ends = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(self.length), [None, pa.py_buffer(ends), pa.py_buffer(self.text[self.inside])])

    def bytes_of(self, i: int, j: int) -> list[bytes]:
        """Words i to j themselves, lower-cased."""
        if i >= j:
            return []
        origin = int(self.start[i])
        data = self.text[origin : int(self.start[j - 1] + self.length[j - 1])].tobytes()
        at = (self.start[i:j] - origin).tolist()
        return [data[a : a + n] for a, n in zip(at, self.length[i:j].tolist(), strict=True)]


def separators(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


#: \x20 and \x09-\x0D
SPACES = separators(b" \t\n\x0b\x0c\r")
#: every ASCII byte but 0-9, A-Z and a-z
NOT_ALNUM = separators(bytes(c for c in range(128) if not chr(c).isalnum()))
#: every ASCII byte but A-Z and a-z
NOT_ALPHA = separators(bytes(c for c in range(128) if not chr(c).isalpha()))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; nulls count as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def chunks(offsets: np.ndarray, max_bytes: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges of at most max_bytes each, and at least one row: bounds the scratch arrays."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + max_bytes, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def tidy() -> None:
    """Gives freed memory back at a task's end: workers live on and share their executor's memory."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def tidied(work):
    """A task's generator that gives memory back once its own variables are gone."""

    def run(batches):
        yield from work(batches)
        tidy()

    return run


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one text; fewer words give one shingle of all."""
    n = len(hashes)
    if n == 0:
        return hashes
    if n < k:
        out = np.array([n], dtype=np.uint64)
        for j in range(n):
            out = mix64(out * _P + hashes[j : j + 1])
        return out
    out = np.full(n - k + 1, np.uint64(k), dtype=np.uint64)
    for j in range(k):
        out = mix64(out * _P + hashes[j : n - k + 1 + j])
    return out
