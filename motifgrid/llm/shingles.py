"""Word shingles of whole texts as sets of 64-bit hashes, many documents at a time.

A-Z are lower-cased, words are runs of bytes other than blank, tab, line feed,
vertical tab, form feed and carriage return. A document's set are its distinct
shingles of five words; with fewer words the whole sequence is its only shingle;
without words it is empty. Everything is computed on the UTF-8 bytes of an Arrow
column, a few numpy passes for a quarter of a megabyte of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
BLOCK_BYTES = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def sorted_distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.append(True, h[1:] != h[:-1])] if len(h) else h


def powers_of_base(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i < n."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, BLOCK_BYTES + 4096)
        factors = np.full((2, n), [[_BASE], [pow(_BASE, -1, 1 << 64)]], np.uint64)
        factors[:, 0] = 1
        _powers[:] = np.multiply.accumulate(factors, axis=1)
    return _powers[0], _powers[1]


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of successive rows with at most `limit` bytes, or of one longer row. Nulls are empty."""
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and how many words precede each document.

    One text of more than a block is read in pieces that end with a blank, so only a
    word of that length needs more memory than a block.
    """
    n = len(data)
    if len(offsets) == 2 and n > 2 * BLOCK_BYTES:
        parts, a = [], 0
        while a < n:
            b = min(n, a + BLOCK_BYTES)
            while b < n and not (ends := np.flatnonzero(_BLANK[data[b : b + 4096]])).size:
                b = min(n, b + 4096)
            b = min(n, b + int(ends[0]) + 1) if b < n else n
            parts.append(word_hashes(data[a:b], np.array([0, 0, b - a]))[0])
            a = b
        found = np.concatenate(parts)
        return found, np.array([0, len(found)])
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    blank = _BLANK[data]
    first = offsets[:-1][offsets[:-1] < n]
    before = np.empty(n, bool)
    before[0], before[1:] = True, blank[:-1]
    before[first] = True
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, blank[1:]
    after[first[first > 0] - 1] = True
    starts = np.flatnonzero(~blank & before)
    ends = np.flatnonzero(~blank & after) + 1
    power, inverse = powers_of_base(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Each document's set as sorted distinct hashes."""
    hashes, place = word_hashes(data, offsets)
    rolled = _rolled(hashes, words)
    found = []
    for a, b in zip(place[:-1].tolist(), place[1:].tolist()):
        if b - a >= words:
            found.append(sorted_distinct(rolled[a : b - words + 1]))
        elif b > a:
            found.append(_rolled(hashes[a:b], b - a))
        else:
            found.append(np.zeros(0, np.uint64))
    return found


def _rolled(hashes: np.ndarray, words: int) -> np.ndarray:
    n = len(hashes) - words + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, words, np.uint64)
    for k in range(words):
        h = h * np.uint64(0x9FB21C651E98DF25) + hashes[k : k + n]
        h ^= h >> np.uint64(29)
    return mix(h)


def sets_of(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    for _, data, offsets in text_blocks(column):
        yield from shingle_sets(data, offsets, words)


def fingerprint(found: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    return int(np.add.reduce(found)).to_bytes(8, "big") + int(np.add.reduce(mix(found ^ np.uint64(0x5851F42D4C957F2D)))).to_bytes(8, "big")
