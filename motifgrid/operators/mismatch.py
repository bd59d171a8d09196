"""Sites of fixed length: a motif that must match, and at most so many mismatches with a pattern.

The motif is checked first, at every start. Windows that pass become bit masks, one
bit a place for each of the four bases, so a pattern of up to 64 letters is compared
with a window by four ANDs and a population count (longer ones by several words).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.alphabet import LETTER, N, ONLY_BASES, encode
from ..plans.spec import SearchSpec
from .block import LETTER_COMPLEMENT, MATCH, Block, blocks

#: Windows that are held as letters at a time.
CHUNK = 1 << 17
#: With so few patterns places are thinned out letter by letter before windows become masks.
FEW = 8


def _planes(sets: np.ndarray) -> np.ndarray:
    """Masks (base, row, word) of rows of codes, one bit for each place that has the base."""
    n, length = sets.shape
    words = -(-length // 64)
    out = np.zeros((4, n, words * 8), np.uint8)
    for base in range(4):
        packed = np.packbits((sets >> base) & 1, axis=1, bitorder="little")
        out[base, :, : packed.shape[1]] = packed
    return out.view(np.uint64)


def _count(masks: np.ndarray) -> np.ndarray:
    return np.bitwise_count(masks).sum(axis=-1, dtype=np.int32)


def motif_starts(codes: np.ndarray, starts: np.ndarray, motif: np.ndarray) -> np.ndarray:
    """Places among starts where every specific letter of the motif has one of its bases."""
    ok = starts.copy()
    n = len(starts)
    bases = ONLY_BASES[codes]
    for k in np.flatnonzero(motif != N):
        ok &= (bases[k : k + n] & motif[k]) > 0
    return np.flatnonzero(ok)


def thin_out(bases: np.ndarray, places: np.ndarray, pattern: np.ndarray, limit: int) -> np.ndarray:
    """Places whose windows have at most `limit` letters outside the pattern's specific ones; most places end after a few letters."""
    count = np.zeros(len(places), np.uint8 if limit < 200 else np.int32)
    for seen, k in enumerate(np.flatnonzero(pattern != N), 1):
        count += (bases[places + k] & pattern[k]) == 0
        if seen > limit + 1 and seen % 2 == 0 and len(places):
            live = count <= limit
            places, count = places[live], count[live]
    return places[count <= limit]


class _Pattern:
    def __init__(self, number: int, forward: bool, pattern: str, motif: str, letters: str):
        self.number, self.forward, self.codes, self.motif = number, forward, encode(pattern), encode(motif)
        self.planes = _planes(self.codes[None, :])[:, 0]
        self.specific = _planes(np.where(self.codes != N, 1, 0).astype(np.uint8)[None, :])[0, 0]
        self.letters = np.frombuffer(letters.encode(), np.uint8)


def compare(windows: np.ndarray, pattern: _Pattern, full: np.ndarray, only: np.ndarray, limit: int, gate: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of windows within the limit, and their mismatches. full, only: the windows' masks with and without ambiguous bases."""
    hits = (only[0] & pattern.planes[0]) | (only[1] & pattern.planes[1]) | (only[2] & pattern.planes[2]) | (only[3] & pattern.planes[3])
    mismatches = _count(pattern.specific & ~hits)
    ok = mismatches <= limit
    if gate:
        agreed = _count(hits) if full is only else sum(_count(full[b] & pattern.planes[b]) for b in range(4))
        ok &= windows.shape[1] - agreed <= limit
    rows = np.flatnonzero(ok)
    return rows, mismatches[rows]


def mark(windows: np.ndarray, pattern: _Pattern) -> np.ndarray:
    """Letters of sites in the pattern's orientation; lower case where a specific letter isn't met, N or n for no base."""
    letters = LETTER[windows]
    letters[letters == 0] = ord("N")
    apart = (pattern.codes != N) & ((ONLY_BASES[windows] & pattern.codes) == 0)
    letters = np.where(apart, letters | 32, letters)
    return letters if pattern.forward else LETTER_COMPLEMENT[letters[:, ::-1]]


def scan_mismatches(tiles: DataFrame, spec: SearchSpec) -> DataFrame:
    """All sites in tiles, which have spec.overlap; one pass, no shuffle."""
    own = [_Pattern(i, forward, p, f, spec.patterns[i % len(spec.patterns)].upper()) for i, forward, p, f in spec.oriented]
    length, limit, gate = spec.length, spec.max_mismatches, spec.strict_gate

    def run(batches):
        for block in blocks(batches, length):
            yield from scan(block)

    def scan(block: Block):
        starts = block.starts(length)
        view = np.lib.stride_tricks.sliding_window_view(block.codes, length)
        for forward in (True, False):
            side = [p for p in own if p.forward == forward]
            places = motif_starts(block.codes, starts, side[0].motif)
            if len(side) <= FEW and all(3 * limit < (p.codes != N).sum() for p in side):
                bases = ONLY_BASES[block.codes]
                rounds = [(thin_out(bases, places, p.codes, limit), [p]) for p in side]
            else:
                rounds = [(places, side)]
            for own_places, patterns in rounds:
                for a in range(0, len(own_places), CHUNK):
                    yield from chunk(block, view, own_places[a : a + CHUNK], patterns)

    def chunk(block: Block, view: np.ndarray, places: np.ndarray, side: list[_Pattern]):
        windows = view[places]
        windows[windows == N] = 0
        only = _planes(ONLY_BASES[windows])
        full = only if not (windows != ONLY_BASES[windows]).any() else _planes(windows)
        for p in side:
            rows, mismatches = compare(windows, p, full, only, limit, gate)
            if len(rows):
                yield block.sites(places[rows], p.number, p.forward, mismatches, mark(windows[rows], p), p.letters[None, :])

    return tiles.mapInArrow(run, MATCH)
