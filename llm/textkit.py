"""Vectorised text kernels shared by the corpus operators.

Everything here works on whole Arrow batches with numpy: words are found by a
byte table (every separator used by the operators is ASCII, so byte and code
point boundaries agree), and a word's 64-bit fingerprint is a difference of a
running polynomial sum, so no Python object per word exists.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd base of the polynomial; its inverse modulo 2**64 shifts a word to position 0.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
#: Bytes of text a kernel handles at once; bounds a worker's memory.
SLICE_BYTES = (2 << 20) - 64

SPACE_CLASS = np.ones(256, bool)
SPACE_CLASS[[0x20, *range(0x09, 0x0E)]] = False
ALNUM_CLASS = np.zeros(256, bool)
ALNUM_CLASS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_RNG = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
BYTE_CODES_2 = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (all bits depend on all bits)."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


_POWERS: dict[int, np.ndarray] = {}
#: Powers kept for the life of a worker; those of a longer text go with it.
KEPT_POWERS = 1 << 21


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.empty(size, U64)
        have[0] = 1
        done = 1
        while done < size:
            step = U64(pow(base, done, 1 << 64))
            have[done : 2 * done] = have[:done] * step
            done *= 2
        if size <= KEPT_POWERS:
            _POWERS[base] = have
    return have[:n]


class Words:
    """Words of a slice of texts.

    start, end: byte positions in buf; doc: index of the text in the slice;
    first: for each text, the index of its first word (len(texts) + 1 entries).
    """

    __slots__ = ("buf", "doc", "end", "first", "offsets", "start")

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, word_class: np.ndarray):
        self.buf, self.offsets = buf, offsets
        n = len(buf)
        inside = np.zeros(n + 2, np.int8)
        inside[1:-1] = word_class[buf]
        edge = np.diff(inside)
        is_start, is_end = edge == 1, edge == -1
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        if len(cut):  # a word never crosses from one text into the next
            joined = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]
            is_start[joined] = True
            is_end[joined] = True
        self.start = np.flatnonzero(is_start)
        self.end = np.flatnonzero(is_end)
        self.first = np.searchsorted(self.start, offsets).astype(np.int64)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def sums(self, lower: bool = False, codes: np.ndarray = BYTE_CODES) -> np.ndarray:
        """Running polynomial sums, of which the fingerprint of any span is a difference."""
        table = codes[LOWER] if lower else codes
        terms = table[self.buf]
        terms *= powers(BASE, len(terms))
        total = np.empty(len(terms) + 1, U64)
        total[0] = 0
        np.cumsum(terms, out=total[1:])
        return total

    def hashes(self, lower: bool = False, codes: np.ndarray = BYTE_CODES) -> np.ndarray:
        """64-bit fingerprints of the words."""
        return span_hashes(self.sums(lower, codes), self.start, self.end)


def span_hashes(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of the bytes from start to end, from running sums."""
    h = total[end] - total[start]
    h *= powers(BASE_INV, len(total))[start]
    return mix(h + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def pieces(buf: np.ndarray, offsets: np.ndarray, word_class: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Parts of a slice of at most `size` bytes (or one word): first text, texts, bytes, offsets.

    A text of more bytes is cut where no word is, so that what is summed over words can be summed over its parts.
    """
    n = len(offsets) - 1
    if len(buf) <= size:
        yield 0, n, buf, offsets
        return
    for k in range(n):
        lo, stop = int(offsets[k]), int(offsets[k + 1])
        while True:
            hi = min(stop, lo + size)
            if hi < stop:  # the last byte outside a word that fits, else the first behind the word
                gaps = np.flatnonzero(~word_class[buf[lo:hi]])
                if len(gaps):
                    hi = lo + int(gaps[-1]) + 1
                else:
                    at = hi
                    while at < stop and word_class[buf[at]]:
                        step = np.flatnonzero(~word_class[buf[at : min(stop, at + size)]])
                        at = at + int(step[0]) if len(step) else min(stop, at + size)
                    hi = at
            yield k, 1, buf[lo:hi], np.array([0, hi - lo])
            lo = hi
            if lo >= stop:
                break


def ngram_hashes(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Fingerprints of the n consecutive words at each index; the last n - 1 entries are of no use.

    Order-dependent: each step mixes before the next word comes in.
    """
    out = h.copy() + U64(seed * 0x632BE59BD9B4E019 & (1 << 64) - 1)
    for k in range(1, n):
        out[:-k or None] = mix(out[:-k or None] * U64(0x9FB21C651E98DF25) + h[k:])
    return out


def span_ok(words: Words, n: int) -> np.ndarray:
    """True where n words starting there belong to one text."""
    last = words.first[words.doc + 1]
    return np.arange(len(words)) + n <= last


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and validity of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    valid = ~np.asarray(column.is_null())
    column = column.cast(pa.large_string()).fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    base, stop = int(offsets[0]), int(offsets[-1])
    buf = np.frombuffer(data, np.uint8)[base:stop] if data is not None else np.empty(0, np.uint8)
    return buf, offsets - base, valid


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows of at most `size` bytes of text (or one row): rows, bytes, offsets, validity."""
    for batch in batches:
        if not batch.num_rows:
            continue
        buf, offsets, valid = texts_of(batch.column(batch.schema.get_field_index(text)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
            hi = min(hi, batch.num_rows)
            yield batch.slice(lo, hi - lo), buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], valid[lo:hi]
            lo = hi
    del batches
    release()


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library keeps no such heap
    _trim = None


def release() -> None:
    """Give freed memory back: a worker that waits for its next task shares the executor's limit with others."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def releasing(work: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same work on a group, with release() behind it."""

    def run(group: pa.Table) -> pa.Table:
        try:
            return work(group)
        finally:
            release()

    return run


def ints(column: pa.Array) -> np.ndarray:
    """int64 values of a column without nulls."""
    return np.asarray(column.cast(pa.int64()))
