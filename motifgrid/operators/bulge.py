"""Sites with bulges: every alignment of a whole pattern within caps on mismatches, genome-only and pattern-only bases.

The walk goes over a pattern's letters from the end where its motif is more specific,
all starting places at once. The letters before the first possible gap thin the
places out; for the rest a table of the least mismatches from each state on is made
from the other end, so the walk goes only where places reach the end. Which gaps are
allowed depends on the pattern's letters alone, so the walk's branches are the finite
set of alignment shapes; every shape yields a row for each place that fits it, without
any choice of a best one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from ..functions.alphabet import LETTER, N, encode
from ..plans.spec import SearchSpec
from .block import LETTER_COMPLEMENT, MATCH, Block, blocks

#: More mismatches than any pattern has letters.
NEVER = 100


def gap_places(pattern: str) -> tuple[list[bool], list[bool]]:
    """Whether a genome base may stand before each letter, and whether each letter may stand alone.

    A genome base stands inside the pattern, not between two Ns; a letter that stands
    alone isn't N, nor are its neighbours.
    """
    wild = [c in "Nn" for c in pattern]
    n = len(wild)
    before = [0 < i < n and not (wild[i - 1] and wild[i]) for i in range(n)]
    alone = [not any(wild[max(0, i - 1) : i + 2]) for i in range(n)]
    return before, alone


def shapes(pattern: str, max_dna: int, max_rna: int) -> list[str]:
    """All alignments' columns: M a letter and a base, D a base alone, R a letter alone."""
    before, alone = gap_places(pattern)
    found: list[str] = []

    def walk(i: int, dna: int, rna: int, columns: str) -> None:
        if i == len(pattern):
            found.append(columns)
            return
        if before[i] and dna < max_dna:
            walk(i, dna + 1, rna, columns + "D")
        if alone[i] and rna < max_rna:
            walk(i + 1, dna, rna + 1, columns + "R")
        walk(i + 1, dna, rna, columns + "M")

    walk(0, 0, 0, "")
    return found


class _Walk:
    """One oriented pattern, read in the direction that meets its motif first."""

    def __init__(self, number: int, forward: bool, pattern: str, motif: str):
        self.number, self.forward, self.pattern = number, forward, pattern
        codes, motif_codes = encode(pattern), encode(motif)
        half = len(codes) / 2
        weight = sum((1 if k >= half else -1) for k in np.flatnonzero(motif_codes != N))
        self.backward = weight > 0
        self.step = -1 if self.backward else 1
        before, alone = gap_places(pattern)
        if self.backward:
            codes, motif_codes, alone = codes[::-1], motif_codes[::-1], alone[::-1]
            before = [False, *before[:0:-1]]
        self.before, self.alone, self.length = before, alone, len(codes)
        self.free = next((i for i in range(self.length) if before[i] or alone[i]), self.length)
        every = np.arange(16)
        # What a genome code does to a letter: 0 is a match, 1 a mismatch, 2 not allowed.
        self.cost = np.zeros((self.length, 16), np.uint8)
        for k, (p, f) in enumerate(zip(codes.tolist(), motif_codes.tolist())):
            fits = (every != 0) & ((p == N) | ((every != N) & ((every & p) > 0)))
            allowed = (every != 0) & ((f == N) | ((every != N) & ((every & f) > 0)))
            self.cost[k] = np.where(allowed, np.where(fits, 0, 1), 2)
        #: Equal for patterns that begin alike.
        self.beginning = (self.backward, self.cost[: self.free].tobytes())

    def start(self, codes: np.ndarray, places: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The places that pass the letters before any gap is allowed, which mostly hold the motif, with their mismatches."""
        mismatches = np.zeros(len(places), np.uint8)
        for i in range(self.free):
            cost = self.cost[i][codes[places + self.step * i]]
            mismatches = mismatches + cost
            live = (cost < 2) & (mismatches <= most)
            places, mismatches = places[live], mismatches[live]
        return places, mismatches

    def least(self, codes: np.ndarray, origin: np.ndarray, max_dna: int, max_rna: int) -> dict[tuple[int, int, int], np.ndarray]:
        """(letters read, DNA bulges, RNA bulges): the least mismatches that the rest costs at each place, from the last letter back."""
        best = {(self.length, d, r): np.zeros(len(origin), np.uint8) for d in range(max_dna + 1) for r in range(max_rna + 1)}
        for i in range(self.length - 1, self.free - 1, -1):
            here = {k: codes[origin + self.step * (i + k)] for k in range(-max_rna, max_dna + 1)}
            cost = {k: np.where(self.cost[i] < 2, self.cost[i], NEVER).astype(np.uint8)[c] for k, c in here.items()}
            for d in range(max_dna, -1, -1):
                for r in range(max_rna, -1, -1):
                    found = np.minimum(cost[d - r] + best[i + 1, d, r], NEVER)
                    if self.alone[i] and r < max_rna:
                        found = np.minimum(found, best[i + 1, d, r + 1])
                    if self.before[i] and d < max_dna:
                        found = np.minimum(found, np.where(here[d - r] != 0, best[i, d + 1, r], NEVER))
                    best[i, d, r] = found.astype(np.uint8)
        return best

    def run(self, codes: np.ndarray, begun: tuple[np.ndarray, np.ndarray], caps: tuple[int, int, int], chunk: int = 1 << 16) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
        """(columns in genome order, first base, place after the last, mismatches) of each shape that fits anywhere. begun: what start() found.

        codes has zeros before and after all places for as many letters as a shape may
        have. The walk enters a branch only with places that reach its end, so it costs
        about as much as its rows.
        """
        most, max_dna, max_rna = caps
        for a in range(0, len(begun[0]), chunk):
            origin, before = begun[0][a : a + chunk], begun[1][a : a + chunk]
            best = self.least(codes, origin, max_dna, max_rna)
            live = np.flatnonzero(before.astype(np.int32) + best[self.free, 0, 0] <= most)
            for columns, rows, mismatches in self._walk(codes, origin, best, (self.free, 0, 0), live, before[live], caps, "M" * self.free):
                width = len(columns) - columns.count("R")
                if self.backward:
                    yield columns[::-1], origin[rows] - width + 1, origin[rows] + 1, mismatches
                else:
                    yield columns, origin[rows], origin[rows] + width, mismatches

    def _walk(self, codes, origin, best, state, rows, mismatches, caps, columns):
        i, d, r = state
        if not len(rows):
            return
        if i == self.length:
            yield columns, rows, mismatches
            return
        here = codes[origin[rows] + self.step * (i + d - r)]
        for column, after, cost in (("D", (i, d + 1, r), None), ("R", (i + 1, d, r + 1), None), ("M", (i + 1, d, r), self.cost[i][here])):
            if column == "D":
                live = (here != 0) if self.before[i] and d < caps[1] else None
            elif column == "R":
                live = np.ones(len(rows), bool) if self.alone[i] and r < caps[2] else None
            else:
                live = cost < 2
            if live is None:
                continue
            total = mismatches if cost is None else mismatches + cost
            live &= total + best[after][rows] <= caps[0]
            if live.any():
                yield from self._walk(codes, origin, best, after, rows[live], total[live], caps, columns + column)


def scan_bulges(tiles: DataFrame, spec: SearchSpec) -> DataFrame:
    """All alignments in tiles, which have spec.overlap; one pass, no shuffle."""
    own = [_Walk(*o) for o in spec.oriented]
    caps = (min(spec.max_mismatches, spec.length), spec.max_dna_bulges, min(spec.max_rna_bulges, spec.length))
    pad = spec.length + spec.max_dna_bulges + spec.max_rna_bulges + 1

    def run(batches):
        for block in blocks(batches, pad):
            starts = np.flatnonzero(block.starts(1))
            everywhere = np.arange(block.size)
            padded = np.concatenate([np.zeros(pad, np.uint8), block.codes])
            begun: dict = {}
            for walk in own:
                if walk.beginning not in begun:
                    begun[walk.beginning] = walk.start(padded, (everywhere if walk.backward else starts) + pad, spec.max_mismatches)
                for columns, first, after, mismatches in walk.run(padded, begun[walk.beginning], caps):
                    yield from sites(block, walk, columns, first - pad, after - pad, mismatches)

    def sites(block: Block, walk: _Walk, columns: str, first: np.ndarray, after: np.ndarray, mismatches: np.ndarray):
        live = np.flatnonzero((first >= 0) & (after > first))
        row = block.row_of(first[live])
        live = live[(after[live] <= block.end[row]) & (first[live] < block.own[row])]
        if not len(live):
            return
        first, mismatches = first[live], mismatches[live]
        kinds = np.frombuffer(columns.encode(), np.uint8)
        dna = np.full((len(first), len(kinds)), ord("-"), np.uint8)
        taken = kinds != ord("R")
        dna[:, taken] = LETTER[block.codes[first[:, None] + np.arange(int(taken.sum()))]]
        rna = np.full(len(kinds), ord("-"), np.uint8)
        rna[kinds != ord("D")] = np.frombuffer(walk.pattern.encode(), np.uint8)
        if not walk.forward:
            dna, rna = LETTER_COMPLEMENT[dna[:, ::-1]], LETTER_COMPLEMENT[rna[::-1]]
        yield block.sites(first, walk.number, walk.forward, mismatches, dna, rna[None, :], columns.count("D"), columns.count("R"))

    return tiles.mapInArrow(run, MATCH)
