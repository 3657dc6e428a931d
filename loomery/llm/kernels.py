"""Numpy kernels over Arrow text columns, run inside Spark tasks.

Work goes slice by slice (about a megabyte), so memory is bounded by the
slice and not by the text, whatever a document's length.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _table(hit) -> np.ndarray:
    return np.array([bool(hit(b)) for b in range(256)])


#: Bytes of words: all but space and 9 to 13.
NOT_BLANK = _table(lambda b: not (b == 32 or 9 <= b <= 13))
#: ASCII letters and digits, and every byte of a longer UTF-8 sequence.
ALNUM = _table(lambda b: b >= 128 or chr(b).isalnum())
#: A-Z to a-z, nothing else.
ASCII_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
AS_IS = np.arange(256, dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply), element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * MULTIPLIER)


_BASE = 0xD1342543DE82EF95


def powers(n: int, base: int = _BASE) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@lru_cache(maxsize=2)
def _scales(n: int) -> tuple[np.ndarray, np.ndarray]:
    return powers(n), powers(n, pow(_BASE, -1, 1 << 64))


def span_hashes(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = AS_IS) -> np.ndarray:
    """A 64-bit hash of each span's folded bytes and length, by differences of
    one running polynomial sum over the part."""
    up, down = _scales(1 << max(20, (len(part)).bit_length()))
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[fold][part] * up[: len(part)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def _cuts(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> Iterator[tuple[int, int]]:
    """Slices of the bytes that end where a document ends or, in a long one, between words."""
    a, last = int(offsets[0]), int(offsets[-1])
    while a < last:
        b = min(a + SLICE, last)
        if b < last:
            within = offsets[np.searchsorted(offsets, b, "right") - 1]
            if within > a:
                b = int(within)
            else:
                end = int(offsets[np.searchsorted(offsets, b, "left")])
                while b < end:
                    gap = np.flatnonzero(~word[data[b : min(b + 4096, end)]])
                    if len(gap):
                        b += int(gap[0])
                        break
                    b = min(b + 4096, end)
        yield a, b
        a = b


def words(data: np.ndarray, offsets: np.ndarray, word: np.ndarray = NOT_BLANK, fold: np.ndarray = AS_IS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each slice (row, hash) of its words in order: the row of ``offsets``
    that a word is in, and a 64-bit hash of its folded bytes."""
    for rows, hashes, _ in shaped_words(data, offsets, word, fold):
        yield rows, hashes


def shaped_words(data: np.ndarray, offsets: np.ndarray, word: np.ndarray = NOT_BLANK, fold: np.ndarray = AS_IS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As ``words``, with a shape from 0 to 7: 1 if it ends in neither letter nor
    digit, 2 if over six bytes, 4 if a byte isn't ASCII."""
    for a, b in _cuts(data, offsets, word):
        part = data[a:b]
        inside = word[part]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        row = offsets[np.searchsorted(offsets, a, "right") : np.searchsorted(offsets, b, "left")] - a
        row = row[(row > 0) & (row < b - a)]
        row = row[inside[row - 1] & inside[row]]
        opens[row], closes[row - 1] = True, True  # a document ends and the next begins without a blank
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        if not len(starts):
            continue
        shape = ~ALNUM[part[ends - 1]] + 2 * (ends - starts > 6)
        shape[np.searchsorted(ends, np.flatnonzero(part >= 128), "right")] |= 4
        yield _rows_of(starts, offsets, a, b), span_hashes(part, starts, ends, fold), shape


def _rows_of(starts: np.ndarray, offsets: np.ndarray, a: int, b: int) -> np.ndarray:
    """Rows of ``offsets`` that spans of the slice (a, b) are in."""
    low, high = np.searchsorted(offsets, (a, b), "right") - 1
    before = np.searchsorted(starts, offsets[low + 1 : high + 1] - a)  # spans before each row that begins here
    return np.repeat(np.arange(low, high + 1), np.diff(np.concatenate(([0], before, [len(starts)]))))


#: Bytes that a pre-token may end with before a single space, and begin with after it: no
#: ASCII blank or control character, and no byte that a longer blank ends or begins with.
_BEFORE = _table(lambda b: 32 < b < 127 or (b >= 128 and b not in (0x85, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF) and not 0x80 <= b <= 0x8A))
_AFTER = _table(lambda b: 32 < b < 127 or (b >= 0xC3 and b not in (0xE1, 0xE2, 0xE3)))


def joins(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether a piece begins and ends as one between two safe places does."""
    inner = np.minimum(starts + 1, len(data) - 1)
    return (ends - starts > 1) & (data[starts] == 32) & _AFTER[data[inner]] & _BEFORE[data[ends - 1]]


def _safe_places(data: np.ndarray, a: int, b: int) -> np.ndarray:
    """Places in [a, b) of single spaces between two bytes as above; a > 0 and b < len(data)."""
    return np.flatnonzero((data[a:b] == 32) & _BEFORE[data[a - 1 : b - 1]] & _AFTER[data[a + 1 : b + 1]]) + a


def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice (row, hash, start, end) of its pieces in order: every text is
    cut before each single space where any pre-token must end, so pieces can be
    tokenized apart."""
    a, last = int(offsets[0]), int(offsets[-1])
    while a < last:
        b = min(a + SLICE, last)
        if b < last:
            within = int(offsets[np.searchsorted(offsets, b, "right") - 1])
            end = int(offsets[np.searchsorted(offsets, b, "left")])
            if within > a:
                b = within
            else:  # inside a long text: at its next safe place
                while b < end:
                    found = _safe_places(data, b, min(b + 4096, end - 1))
                    if len(found):
                        b = int(found[0])
                        break
                    b = min(b + 4096, end) if b + 4096 < end - 1 else end
        begins = np.zeros(b - a, bool)
        begins[0] = True
        begins[offsets[np.searchsorted(offsets, a, "right") : np.searchsorted(offsets, b, "left")] - a] = True
        if b - a > 2:
            begins[_safe_places(data, a + 1, b - 1) - a] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], b - a)
        yield _rows_of(starts, offsets, a, b), span_hashes(data[a:b], starts, ends), starts + a, ends + a
        a = b


def row_slices(batch: pa.RecordBatch, offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes of text, one row at least."""
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


def text_slices(batches: Iterator[pa.RecordBatch], most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``most`` bytes of their column ``text``;
    memory that the task no longer needs goes back to the system at the end."""
    for batch in batches:
        _, offsets = utf8(batch.column("text"))
        for a, b in row_slices(batch, offsets, most):
            yield batch.slice(a, b - a)
    give_back()


def give_back() -> None:
    """Free memory of this worker to the system: Arrow's pool, and the C library's where it can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
