"""Nucleotide codes and the functions on them, for numpy arrays, strings and columns.

A code is a set of bases as bits: T = 1, C = 2, A = 4, G = 8. Code 0 is an unknown
character, code 15 is N; the two are told apart everywhere.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The IUPAC codes of sets of bases.
CODES = {
    "T": 1, "C": 2, "A": 4, "G": 8,
    "R": 12, "Y": 3, "S": 10, "W": 5, "K": 9, "M": 6,
    "B": 11, "D": 13, "H": 7, "V": 14, "N": 15,
}
#: The letters and their complements, in the same order.
LETTERS, COMPLEMENTS = "ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN"
N = 15


def _lookup(pairs: dict[str, int], default: int = 0) -> np.ndarray:
    table = np.full(256, default, np.uint8)
    for letter, value in pairs.items():
        table[ord(letter)] = table[ord(letter.lower())] = value
    return table


#: Code of a byte; of a byte if only A, C, G and T count; letter of a code (0 is byte 0).
CODE = _lookup(CODES)
STRICT = _lookup({k: v for k, v in CODES.items() if k in "TCAG"})
LETTER = np.zeros(16, np.uint8)
LETTER[list(CODES.values())] = [ord(k) for k in CODES]
#: Codes with all but A, C, G and T removed.
ONLY_BASES = np.array([c if c in (1, 2, 4, 8) else 0 for c in range(16)], np.uint8)
#: Complement of a code: its bits rotated by two places.
COMPLEMENT = np.array([((c << 2) | (c >> 2)) & 15 for c in range(16)], np.uint8)


def encode(text: str | bytes, mixed: bool = True) -> np.ndarray:
    """Codes of a sequence; without `mixed` only A, C, G and T have one."""
    raw = text.encode("latin-1", "replace") if isinstance(text, str) else bytes(text)
    return (CODE if mixed else STRICT)[np.frombuffer(raw, np.uint8)]


def decode(codes: np.ndarray) -> bytes:
    """Upper-case letters of codes; code 0 is byte 0."""
    return LETTER[codes].tobytes()


def unpack_bases(packed: np.ndarray | bytes, n: int) -> np.ndarray:
    """Codes of n bases at two bits each, first base in the high bits, T C A G as 0 to 3."""
    raw = np.frombuffer(bytes(packed), np.uint8)
    pairs = (raw[:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3
    return (np.uint8(1) << pairs.ravel()[:n]).astype(np.uint8)


def fill(codes: np.ndarray, value: int, start: int, end: int) -> np.ndarray:
    """A copy with codes[start:end] set to a value."""
    out = codes.copy()
    out[start:end] = value
    return out


def mask_n(codes: np.ndarray) -> np.ndarray:
    """N as unknown."""
    return np.where(codes == N, 0, codes).astype(np.uint8)


_SWAP = str.maketrans(LETTERS + LETTERS.lower(), COMPLEMENTS + COMPLEMENTS.lower())


def complement(text: str) -> str:
    """Complement letter by letter; case is kept, other characters stay."""
    return text.translate(_SWAP)


def reverse_complement(text: str) -> str:
    return complement(text)[::-1]


def is_mixed_base(text: str) -> bool:
    """Whether every character has a code."""
    return bool((CODE[np.frombuffer(text.encode("utf-8"), np.uint8)] > 0).all())


def matches(dna: str, rna: str) -> bool:
    """Whether a base of the genome, A, C, G or T, is in the set of a pattern's letter."""
    return bool(STRICT[ord(dna) & 255] & CODE[ord(rna) & 255])


def motif_orientation(motif: str) -> tuple[bool, int]:
    """(the specific part comes first, its length); with as many Ns on either side it comes last."""
    upper = motif.upper()
    left, right = len(upper) - len(upper.lstrip("N")), len(upper) - len(upper.rstrip("N"))
    return (False, len(upper) - left) if left >= right else (True, len(upper) - right)


def guide_of(pattern: str, motif_first: bool, motif_length: int) -> str:
    return pattern[motif_length:] if motif_first else pattern[: len(pattern) - motif_length]


def trailing_n(pattern: str) -> int:
    return len(pattern) - len(pattern.rstrip("Nn"))


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def round_up(a: int, b: int) -> int:
    return ceil_div(a, b) * b


# --- columns


def complement_column(seq: Column) -> Column:
    return F.translate(seq, LETTERS + LETTERS.lower(), COMPLEMENTS + COMPLEMENTS.lower())


def reverse_complement_column(seq: Column) -> Column:
    return F.reverse(complement_column(seq))


def is_mixed_base_column(seq: Column) -> Column:
    return seq.rlike(f"^[{LETTERS}{LETTERS.lower()}]*\\z")


def canonical_column(seq: Column) -> Column:
    """Upper-case letters; characters without a code become byte 0."""
    return F.regexp_replace(F.upper(seq), f"[^{LETTERS}]", "\0")


def code_column(letter: Column) -> Column:
    """Code of a one-letter column."""
    return F.coalesce(F.get(F.array(*(F.lit(CODES[c]) for c in LETTERS)), F.instr(F.lit(LETTERS), F.upper(letter)) - 1), F.lit(0))


def letter_column(code: Column) -> Column:
    """Letter of a code column; code 0 is byte 0."""
    return F.get(F.array(*(F.lit(chr(c)) for c in LETTER)), code)


def motif_orientation_column(motif: Column) -> tuple[Column, Column]:
    left, right = (F.length(F.regexp_extract(motif, p, 0)) for p in ("^[Nn]*", "[Nn]*$"))
    return left < right, F.length(motif) - F.greatest(left, right)


def guide_column(pattern: Column, motif_first: Column, motif_length: Column) -> Column:
    n = F.length(pattern) - motif_length
    return F.when(motif_first, F.substring(pattern, motif_length + 1, n)).otherwise(F.substring(pattern, F.lit(1), n))


def bulge_label(dna: Column, rna: Column) -> Column:
    """X without bulges, DNA if the genome has any, else RNA."""
    return F.when(dna + rna == 0, "X").when(dna > 0, "DNA").otherwise("RNA")


def reported_position(start: Column, forward: Column, dna_bulges: Column, trailing: int) -> Column:
    """The start; on the reverse strand moved by the motif's length less one, less the DNA bulges."""
    shift = F.greatest(F.lit(max(trailing - 1, 0)) - dna_bulges, F.lit(0))
    return F.when(forward, start).otherwise(start + shift).cast("long")
