"""Word shingles as numpy arrays, for operators that hash whole texts in Arrow batches.

A batch of texts is read as one run of UTF-8 bytes. A table says for each byte
whether it separates words, and what it counts as (so that A-Z may count as
a-z). A word's hash is a polynomial of its bytes, taken from running sums over
the batch; the hash of k words is a polynomial of their hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so that multiplying by it loses nothing
# Bytes that separate words (0), or what they count as.
WHITE_SPACE = np.arange(1, 257, dtype=np.uint64)
WHITE_SPACE[[0x20, *range(0x09, 0x0E)]] = 0
LETTERS = np.array([ord(chr(b).lower()) + 1 if b < 128 and chr(b).isalnum() else (b + 1) * (b >= 128) for b in range(256)], np.uint64)
ASCII_LETTERS = np.where(np.arange(256) < 128, LETTERS, 0).astype(np.uint64)

PLACES = 32  # of a word, whose numbers are kept in a table
SECOND = 0x632BE59BD9B4E019  # seed of the independent second hash

_known: dict[int, np.ndarray] = {}


def small(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut to about ``size`` bytes of text (one row at least): working arrays take some twenty times that."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size)))
            yield batch.slice(lo, hi - lo)
            lo = hi


def _numbers(key: np.ndarray, seed: int) -> np.ndarray:
    """The pseudo-random number of each key (place and byte)."""
    return mixed((key + np.uint64(1)) * _STEP ^ np.uint64(seed))


def _table(seed: int) -> np.ndarray:
    if seed not in _known:
        _known[seed] = _numbers(np.arange(PLACES << 9, dtype=np.uint64), seed)
    return _known[seed]


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    strings = column.fill_null("").cast(pa.large_string())
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def hashed_words(column: pa.Array, table: np.ndarray = WHITE_SPACE, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, offsets) of a string column: the words of row i are hashes[offsets[i]:offsets[i + 1]]."""
    data, at = raw_bytes(column)
    hashes, counts = [np.empty(0, np.uint64)], [np.zeros(1, np.int64)]
    lo = 0
    while lo < len(at) - 1:  # some rows at a time, as working arrays take eight bytes for each byte
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + (1 << 20))))
        hi = min(hi, len(at) - 1)
        part, cuts = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        first, last = word_spans(part, cuts, table)
        hashes.append(span_hashes(part, first, last, table, seed))
        counts.append(np.diff(np.searchsorted(first, cuts)))
        lo = hi
    return np.concatenate(hashes), np.cumsum(np.concatenate(counts))


def word_spans(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte, and byte after the last, of every word; rows begin at ``at`` and hold whole words."""
    inside = table[data] != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = at[1:-1][(at[1:-1] < len(data))]
    begins[cut] = inside[cut]  # the first byte of a row begins a word
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def span_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray, table: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of every word."""
    if not len(first):
        return np.empty(0, np.uint64)
    size = last - first
    begins = np.cumsum(size) - size
    place = np.arange(begins[-1] + size[-1]) - np.repeat(begins, size)
    key = (place.astype(np.uint64) << np.uint64(9)) + table[data[np.repeat(first, size) + place]]
    far = np.flatnonzero(place >= PLACES)
    if len(far):
        beyond = _numbers(key[far], seed)
        key[far] = 0
    numbers = _table(seed)[key]
    if len(far):
        numbers[far] = beyond
    return mixed(np.add.reduceat(numbers, begins))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def odd_factors(n: int, seed: int) -> np.ndarray:
    """Fixed pseudo-random odd numbers, one for each MinHash function: products with multiples of one number are not independent."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(seed)) | np.uint64(1)


def rolled(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words that start at each place; the last k - 1 places are dropped. Order counts."""
    n = len(values) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = values[:n].copy()
    for j in range(1, k):
        out *= _STEP
        out += values[j : j + n]
    return mixed(out)


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row of every place of the flat array."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def whole(offsets: np.ndarray, k: int) -> np.ndarray:
    """Which of the ``rolled`` places lie in one row with all their k words."""
    n = offsets[-1] - k + 1
    if n <= 0:
        return np.empty(0, bool)
    ends = np.repeat(offsets[1:], np.diff(offsets))[:n]
    return np.arange(n) + k <= ends


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of one text; a shorter text, not empty, is one shingle."""
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(rolled(words, min(k, len(words))))
