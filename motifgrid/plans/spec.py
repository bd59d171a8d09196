"""What a search asks for: its specification, the query file and the command line."""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import cached_property

from ..functions.alphabet import is_mixed_base, reverse_complement, trailing_n
from ..functions.align import MAX_PATTERN


class SearchError(Exception):
    """Any error of a search's own."""


class ArgumentError(SearchError):
    """A query or an argument that can't be searched."""


class BadFileFormat(SearchError):
    """A genome file that can't be read."""


@dataclass(frozen=True)
class SearchSpec:
    """motif: letters that the genome must have, N where anything goes, in the guides' orientation.
    strict_gate: count a genome N under a pattern's N against the mismatches that are allowed, though it isn't reported."""

    motif: str
    patterns: tuple[str, ...]
    max_mismatches: int
    max_dna_bulges: int = 0
    max_rna_bulges: int = 0
    strict_gate: bool = True

    def __post_init__(self):
        if not self.patterns:
            raise ArgumentError("a search has at least one pattern")
        for text in (self.motif, *self.patterns):
            if not text or not is_mixed_base(text):
                raise ArgumentError(f"{text!r} isn't a string of base letters")
        if any(len(p) != len(self.motif) for p in self.patterns):
            raise ArgumentError("all patterns are as long as the motif")
        if min(self.max_mismatches, self.max_dna_bulges, self.max_rna_bulges) < 0:
            raise ArgumentError("limits aren't negative")
        if self.bulges and len(self.motif) > MAX_PATTERN:
            raise ArgumentError(f"with bulges a pattern has at most {MAX_PATTERN} letters")

    @property
    def bulges(self) -> bool:
        return self.max_dna_bulges > 0 or self.max_rna_bulges > 0

    @property
    def length(self) -> int:
        return len(self.motif)

    @property
    def overlap(self) -> int:
        """Bases after its own that a tile needs."""
        return self.length + self.max_dna_bulges - 1

    @property
    def trailing(self) -> int:
        """Ns at the end of the first pattern, which set the reported position on the reverse strand."""
        return trailing_n(self.patterns[0])

    @cached_property
    def oriented(self) -> tuple[tuple[int, bool, str, str], ...]:
        """(pattern's number, forward, pattern, motif) as read on the forward strand; reverse ones are numbered on from the forward ones."""
        ahead = [(i, True, p.upper(), self.motif.upper()) for i, p in enumerate(self.patterns)]
        back = [(i + len(self.patterns), False, reverse_complement(p), reverse_complement(f)) for i, _, p, f in ahead]
        return (*ahead, *back)


@dataclass(frozen=True)
class QueryFile:
    genome: str
    spec: SearchSpec
    labels: tuple[str | None, ...] = ()


def _whole(text: str, what: str) -> int:
    if not text.removeprefix("+").isascii() or not text.removeprefix("+").isdigit() or int(text) >= 1 << 32:
        raise ArgumentError(f"{what} is a whole number, not negative")
    return int(text)


def parse_query(text: str) -> QueryFile:
    """A genome's path; a motif, or a motif and limits of DNA and RNA bulges; lines of a pattern, its mismatches and perhaps a label."""
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    lines = [line.removesuffix("\r") for line in lines]
    if len(lines) < 2:
        raise ArgumentError("a query has at least 3 lines")
    parts = lines[1].split()
    if len(parts) not in (1, 3):
        raise ArgumentError("the 2nd line is: <motif> [<DNA bulges> <RNA bulges>]")
    dna, rna = (_whole(p, "a limit of bulges") for p in parts[1:]) if len(parts) == 3 else (0, 0)
    if not is_mixed_base(parts[0]):
        raise ArgumentError("the motif isn't a string of base letters")
    patterns, limits, labels = [], [], []
    for line in lines[2:]:
        own = line.split()
        if len(own) not in (2, 3):
            raise ArgumentError("a pattern's line is: <pattern> <mismatches> [<label>]")
        if not is_mixed_base(own[0]):
            raise ArgumentError("a pattern isn't a string of base letters")
        limits.append(_whole(own[1], "the number of mismatches"))
        if limits[0] != limits[-1]:
            raise ArgumentError("all lines have the same number of mismatches")
        labels.append(own[2] if len(own) == 3 else None)
        if labels[0] is not None and labels[-1] is None:
            raise ArgumentError("if the first pattern has a label, all have")
        if len(own[0]) != len(parts[0]):
            raise ArgumentError("all patterns are as long as the motif")
        patterns.append(own[0])
    if not patterns:
        raise ArgumentError("a query has at least one pattern")
    return QueryFile(lines[0], SearchSpec(parts[0], tuple(patterns), limits[0], dna, rna), tuple(labels))


def read_query(path: str) -> QueryFile:
    """The query of a file, or of the standard input for `-`."""
    if path == "-":
        return parse_query(sys.stdin.read())
    with open(path, encoding="utf-8", newline="") as file:
        return parse_query(file.read())


@dataclass(frozen=True)
class Arguments:
    query: str
    device: str
    out: str


def parse_arguments(args: list[str]) -> Arguments | None:
    """Query file, device letter, output; None without any, which asks for help. More arguments are ignored."""
    if not args:
        return None
    if len(args) < 3:
        raise ArgumentError("too few arguments, 3 are needed")
    if args[1] not in ("C", "G", "A"):
        raise ArgumentError("the device is C, G or A")
    return Arguments(*args[:3])
