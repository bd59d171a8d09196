"""The searches as plain SQL for DuckDB: the same questions asked in another way, to check results."""

from __future__ import annotations

from ..functions.alphabet import CODES, trailing_n
from ..operators.bulge import shapes
from .spec import SearchSpec

#: Which base stands for which letter in the genome that is made of documents; A, C, G, T and N stand for themselves.
LETTERS_FROM, LETTERS_TO = "BDEFHIJKLMOPQRSUVWXYZ", "ACGTACGTACTACNGTCATCG"
WINDOW = 256

GENOME = f"SELECT doc_id, 'doc' || doc_id AS chr_name, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{LETTERS_FROM}', '{LETTERS_TO}') AS seq FROM documents"


def bases(letter: str) -> str:
    """The bases of a pattern's letter."""
    return "".join(b for b in "ACGT" if CODES[b] & CODES[letter.upper()])


def windows(spans: set[int], genome: str = GENOME) -> str:
    """Common tables w<span>(chr_name, pos, dir, x): all windows of both strands, x as read along the strand."""
    longest = max(spans)
    parts = [
        f"genome AS MATERIALIZED ({genome})",
        f"tiles AS MATERIALIZED (SELECT chr_name, t AS start, length(seq) - t AS rest, substr(seq, t + 1, {WINDOW + longest}) AS w FROM genome, unnest(range(0, length(seq), {WINDOW})) AS u(t))",
        f"places AS MATERIALIZED (SELECT chr_name, start + p AS pos, rest - p AS rest, substr(w, p + 1, {longest}) AS y FROM tiles, unnest(range(0, least({WINDOW}, rest))) AS u(p))",
    ]
    for span in sorted(spans):
        ahead = f"SELECT chr_name, pos, '+' AS dir, substr(y, 1, {span}) AS x FROM places WHERE rest >= {span}"
        back = f"SELECT chr_name, pos, '-' AS dir, reverse(translate(substr(y, 1, {span}), 'ACGT', 'TGCA')) AS x FROM places WHERE rest >= {span}"
        parts.append(f"w{span} AS (SELECT * FROM ({ahead} UNION ALL {back}))")
    return ",\n".join(parts)


def _letter(k: int) -> str:
    return f"substr(x, {k + 1}, 1)"


def _apart(letter: str, k: int) -> str:
    return f"(strpos('{bases(letter)}', {_letter(k)}) = 0)::INT"


def _sum(terms: list[str]) -> str:
    return " + ".join(terms) or "0"


def _fits(motif: str, places: list[int | None]) -> str:
    return " AND ".join(f"strpos('{bases(f)}', {_letter(k)}) > 0" for f, k in zip(motif, places) if f.upper() != "N" and k is not None) or "TRUE"


def _position(spec: SearchSpec, dna: int) -> str:
    shift = max(max(trailing_n(spec.patterns[0]) - 1, 0) - dna, 0)
    return f"CASE dir WHEN '+' THEN pos ELSE pos + {shift} END::BIGINT"


def mismatch_search(spec: SearchSpec, genome: str = GENOME) -> str:
    """The eight columns of a search without bulges, in a genome of A, C, G, T and N."""
    n, parts = spec.length, []
    places = list(range(n))
    for pattern in spec.patterns:
        pattern = pattern.upper()
        count = _sum([_apart(p, k) for k, p in enumerate(pattern) if p != "N"])
        spent = _sum([_apart(p, k) for k, p in enumerate(pattern)]) if spec.strict_gate else count
        marked = " || ".join(_letter(k) if p == "N" else f"CASE WHEN strpos('{bases(p)}', {_letter(k)}) = 0 THEN lower({_letter(k)}) ELSE {_letter(k)} END" for k, p in enumerate(pattern))
        parts.append(f"SELECT 'X' AS bulge_type, '{pattern}' AS crrna, {marked} AS dna, chr_name AS chromosome, {_position(spec, 0)} AS position, dir AS direction, ({count})::INTEGER AS mismatches, 0::INTEGER AS bulge_size FROM sites WHERE ({spent}) <= {spec.max_mismatches}")
    return f"WITH {windows({n}, genome)},\nsites AS MATERIALIZED (SELECT * FROM w{n} WHERE {_fits(spec.motif, places)})\n" + "\nUNION ALL ".join(parts)


def bulge_search(spec: SearchSpec, genome: str = GENOME) -> str:
    """The eight columns of a search with bulges: every shape of an alignment is a query of its own."""
    found = [(p.upper(), s) for p in spec.patterns for s in shapes(p, spec.max_dna_bulges, spec.max_rna_bulges)]
    spans, parts = {len(s) - s.count("R") for _, s in found}, []
    for pattern, shape in found:
        letter = base = 0
        dna, rna, place = [], "", [None] * len(pattern)
        for c in shape:
            dna.append("'-'" if c == "R" else _letter(base))
            rna += "-" if c == "D" else pattern[letter]
            if c == "M":
                place[letter] = base
            letter, base = letter + (c != "D"), base + (c != "R")
        count = _sum([_apart(p, k) for p, k in zip(pattern, place) if k is not None and p != "N"])
        d, r = shape.count("D"), shape.count("R")
        kind = "X" if d + r == 0 else "DNA" if d else "RNA"
        parts.append(f"SELECT '{kind}' AS bulge_type, '{rna}' AS crrna, {' || '.join(dna)} AS dna, chr_name AS chromosome, {_position(spec, d)} AS position, dir AS direction, ({count})::INTEGER AS mismatches, {d + r}::INTEGER AS bulge_size FROM m{base} WHERE ({count}) <= {spec.max_mismatches} AND {_fits(spec.motif, place)}")
    # A motif at one end, beyond all gaps, is checked once for each span.
    head = len(spec.motif) - len(spec.motif.lstrip("Nn"))
    kept = []
    for span in sorted(spans):
        at = [span - spec.length + k if head else k for k in range(spec.length)]
        kept.append(f"m{span} AS MATERIALIZED (SELECT * FROM w{span} WHERE {_fits(spec.motif, [k if k >= 0 else None for k in at])})")
    return f"WITH {windows(spans, genome)},\n" + ",\n".join(kept) + "\n" + "\nUNION ALL ".join(parts)


def semiglobal(pattern: str, genome: str = GENOME, loose: bool = False) -> str:
    """Least edits between a pattern and an end of each sequence: the table of costs, row by row, as lists. loose: a sequence's N matches every letter.

    Without any base the pattern costs its length m, and each base beyond m costs one
    more, so no best end is longer than 2 m: the last 2 m bases decide for the whole.
    """
    texts = f"SELECT doc_id AS id, length(seq)::BIGINT AS n, right(seq, {2 * len(pattern)}) AS t FROM ({genome})"
    rows = ["d0 AS (SELECT id, n, t, list_transform(range(0, length(t) + 1), lambda j: 0) AS d FROM texts)"]
    for i, p in enumerate(pattern.upper(), 1):
        apart = f"(strpos('{p}{'N' if loose else ''}', substr(t, j::INT, 1)) = 0)::INT" if p in "ACGT" else "0"
        best = f"list_transform(range(0, length(t) + 1), lambda j: CASE WHEN j = 0 THEN {i} ELSE least(d[j::INT] + {apart}, d[j::INT + 1] + 1) END)"
        # A step along the text costs 1: the least of c[k] + (j - k) over k <= j, as a running minimum of c[k] - k.
        rows.append(f"c{i} AS (SELECT id, n, t, {best} AS c FROM d{i - 1})")
        running = "list_transform(range(0, length(t) + 1), lambda j: list_min(list_transform(range(0, j + 1), lambda k: c[k::INT + 1] - k)) + j)"
        rows.append(f"d{i} AS (SELECT id, n, t, {running} AS d FROM c{i})")
    return f"WITH texts AS ({texts}),\n" + ",\n".join(rows) + f"\nSELECT id, n, d[length(t) + 1]::INTEGER AS distance FROM d{len(pattern)}"
