"""Pairwise functions: semi-global edit distance and one best alignment, plain and as columns."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
MAX_PATTERN = 64


@dataclass(frozen=True)
class MatchTable:
    """Bits of the places where a pattern takes each base; `wild` are those that take any, and a genome N."""

    rows: dict[str, int]
    wild: int
    length: int


def match_table(pattern: str) -> MatchTable:
    """A letter other than A, C, G or T takes every base."""
    if len(pattern) > MAX_PATTERN:
        raise ValueError(f"a pattern has at most {MAX_PATTERN} letters")
    upper = pattern.upper()
    wild = sum(1 << i for i, c in enumerate(upper) if c not in BASES)
    return MatchTable({b: wild | sum(1 << i for i, c in enumerate(upper) if c == b) for b in BASES}, wild, len(upper))


def reach(length: int) -> int:
    """Letters before a text's end that any best alignment of a pattern of that length can use: in as many
    letters as the pattern has it costs `length` at most, so a better one has at most that many D."""
    return 2 * length


def edit_distance(table: MatchTable, text: str) -> int:
    """Least edits that turn the whole pattern into a suffix of the text, column by column on bit vectors."""
    if not table.length:
        return 0
    full, last = (1 << table.length) - 1, 1 << table.length - 1
    higher, lower, score = full, 0, table.length
    for c in text[-reach(table.length) :].upper():
        hit = table.rows.get(c, table.wild)
        step = ((((hit | lower) & higher) + higher) ^ higher) | hit | lower
        up, down = (lower | ~(higher | step)) & full, higher & step
        score += bool(up & last) - bool(down & last)
        # The first row stays 0, so nothing is carried in from below.
        up = (up << 1) & full
        lower, higher = up & step, ((down << 1) | ~(up | step)) & full
    return score


@dataclass(frozen=True)
class Alignment:
    """ops: M match, S substitution, D base in the genome only, R in the pattern only."""

    ops: str
    pattern_aligned: str
    text_aligned: str
    text_start: int
    mismatches: int
    dna_bulges: int
    rna_bulges: int


def loosely_equal(a: str, b: str) -> bool:
    """Equal but for case, or either is N."""
    a, b = a.upper(), b.upper()
    return a == b or a == "N" or b == "N"


def code_matches(pattern: int, text: int) -> bool:
    """The rule on codes: an unknown base matches nothing, a pattern's N anything else, a genome's N no specific base."""
    return text != 0 and (pattern == 15 or (text != 15 and bool(pattern & text)))


def best_alignment(pattern: str, text: str, max_edits: int, max_dna: int, max_rna: int) -> Alignment | None:
    """One alignment of the pattern with a suffix of the text, of least cost; on ties a diagonal step before an R before a D, from the end."""
    no = 1 << 30
    dna, rna = (1 if max_dna else no), (1 if max_rna else no)
    skipped = max(0, len(text) - reach(len(pattern)))
    text = text[skipped:]
    m, n = len(pattern), len(text)
    cost = [[min(i * rna, no)] + [0] * n if i else [0] * (n + 1) for i in range(m + 1)]
    apart = [[int(not loosely_equal(p, t)) for t in text] for p in pattern]
    for i in range(1, m + 1):
        above, here = cost[i - 1], cost[i]
        for j in range(1, n + 1):
            here[j] = min(above[j - 1] + apart[i - 1][j - 1], above[j] + rna, here[j - 1] + dna)
    if cost[m][n] > max_edits:
        return None
    columns, i, j = [], m, n
    while i:
        if j and cost[i][j] == cost[i - 1][j - 1] + apart[i - 1][j - 1]:
            i, j = i - 1, j - 1
            columns.append(("S" if apart[i][j] else "M", pattern[i], text[j]))
        elif not j or cost[i][j] == cost[i - 1][j] + rna:
            i -= 1
            columns.append(("R", pattern[i], "-"))
        else:
            j -= 1
            columns.append(("D", "-", text[j]))
    ops, left, right = ("".join(c[k] for c in reversed(columns)) for k in range(3))
    return Alignment(ops, left, right, skipped + j, ops.count("S"), ops.count("D"), ops.count("R"))


ALIGNMENT = "ops string, pattern_aligned string, text_aligned string, text_start int, mismatches int, dna_bulges int, rna_bulges int"


def edit_distance_column(pattern: str, text: Column) -> Column:
    """Semi-global edit distance of a fixed pattern with each text; null for null."""
    table = match_table(pattern)

    @F.pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else edit_distance(table, t) for t in texts], dtype="Int32")

    return run(text)


def best_alignment_column(pattern: str, text: Column, max_edits: int, max_dna: int, max_rna: int) -> Column:
    """A struct column of best_alignment(); null where there is none."""

    @F.pandas_udf(f"found boolean, {ALIGNMENT}")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [(best_alignment(pattern, t, max_edits, max_dna, max_rna) if t is not None else None) for t in texts]
        empty = (False, None, None, None, None, None, None, None)
        return pd.DataFrame([(True, *vars(r).values()) if r else empty for r in rows], columns=["found", "ops", "pattern_aligned", "text_aligned", "text_start", "mismatches", "dna_bulges", "rna_bulges"])

    found = run(text)
    return F.when(found["found"], found)
