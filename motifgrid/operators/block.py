"""Runs of tiles as flat arrays, and sites found in them as Arrow rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ..functions.alphabet import CODE, COMPLEMENT, LETTER

#: Bases that are scanned at a time.
BLOCK = 1 << 21

MATCH = "chr_ord long, chr_name string, chrom_idx long, pattern_idx int, mismatches int, is_forward boolean, dna_seq string, rna_seq string, dna_bulge_size int, rna_bulge_size int"
_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.int32(), pa.int32()]
_NAMES = [part.split()[0] for part in MATCH.split(", ")]

#: Complement of a letter, upper or lower case; other bytes stay.
LETTER_COMPLEMENT = np.arange(256, dtype=np.uint8)
for _code in range(1, 16):
    _a, _b = int(LETTER[_code]), int(LETTER[COMPLEMENT[_code]])
    LETTER_COMPLEMENT[_a], LETTER_COMPLEMENT[_a + 32] = _b, _b + 32


class Block:
    """Successive tiles of a batch, their bases end to end.

    codes: of all bases, then `pad` zeros. begin, end: of each tile in codes; own: the
    end of the starts that it owns. row_of: the tile of a place.
    """

    def __init__(self, batch: pa.RecordBatch, pad: int):
        seq = batch["seq"]
        offsets = np.frombuffer(seq.buffers()[1], np.int32, len(seq) + 1, seq.offset * 4).astype(np.int64)
        raw = np.frombuffer(seq.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        self.batch, self.pad = batch, pad
        self.begin, self.end = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
        self.own = self.begin + batch["own"].to_numpy()
        self.codes = np.zeros(len(raw) + pad, np.uint8)
        self.codes[: len(raw)] = CODE[raw]
        self.size = len(raw)

    def row_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, places, "right") - 1

    def starts(self, span: int) -> np.ndarray:
        """Whether a place is a start that its tile owns and has `span` bases from there on in the tile."""
        change = np.zeros(self.size + 1, np.int32)
        last = np.minimum(self.own, self.end - span + 1)
        live = last > self.begin
        np.add.at(change, self.begin[live], 1)
        np.add.at(change, last[live], -1)
        return np.cumsum(change)[:-1] > 0

    def sites(self, places: np.ndarray, pattern: int, forward: bool, mismatches: np.ndarray, dna: np.ndarray, rna: np.ndarray, dna_bulges: int = 0, rna_bulges: int = 0) -> pa.RecordBatch:
        """Rows of sites; dna and rna are matrices of letters, one row a site, or one row of rna for all."""
        n = len(places)
        rows = self.row_of(places)
        at = pa.array(rows)
        where = self.batch["tile_start"].to_numpy()[rows] + places - self.begin[rows]
        same = lambda value, kind: pa.array(np.full(n, value), kind)
        columns = [
            self.batch["chr_ord"].take(at), self.batch["chr_name"].take(at), pa.array(where), same(pattern, pa.int32()), pa.array(mismatches.astype(np.int32)), same(forward, pa.bool_()),
            strings(dna), strings(np.broadcast_to(rna, (n, rna.shape[-1]))), same(dna_bulges, pa.int32()), same(rna_bulges, pa.int32()),
        ]
        return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, _TYPES)], names=_NAMES)


def strings(letters: np.ndarray) -> pa.Array:
    """A matrix of ASCII letters as strings, one for each row."""
    n, width = letters.shape
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters)))


def blocks(batches, pad: int, limit: int = BLOCK) -> Iterator[Block]:
    """The tiles of all batches in blocks of at most about `limit` bases, whole tiles at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(np.diff(np.frombuffer(batch["seq"].buffers()[1], np.int32, batch.num_rows + 1, batch["seq"].offset * 4)))
        a = 0
        while a < batch.num_rows:
            before = sizes[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(sizes, before + limit, "right")))
            yield Block(batch.slice(a, b - a), pad)
            a = b
