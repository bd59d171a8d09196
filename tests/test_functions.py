import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifgrid.functions import alphabet as a
from motifgrid.functions.align import best_alignment, best_alignment_column, code_matches, edit_distance, edit_distance_column, loosely_equal, match_table


def test_codes():
    assert [a.CODE[ord(c)] for c in "TCAGNn-U"] == [1, 2, 4, 8, 15, 15, 0, 0]
    assert a.decode(a.encode("acgtRYn-x")) == b"ACGTRYN\0\0"
    assert a.decode(a.encode("ACGTNR", mixed=False)) == b"ACGT\0\0"
    assert a.decode(a.encode("ACGTACGT")[2:5]) == b"GTA"
    assert a.decode(a.fill(a.encode("ACGT"), a.N, 1, 3)) == b"ANNT"
    assert a.decode(a.unpack_bases(bytes([0b00011011, 0b11000000]), 5)) == b"TCAGG"
    assert a.mask_n(a.encode("ANR")).tolist() == [4, 0, 12]
    for c in a.LETTERS:
        assert a.COMPLEMENT[a.CODES[c]] == a.CODES[a.complement(c)]
        assert set(b for b in "ACGT" if a.CODES[b] & a.CODES[c]) == {a.complement(b) for b in "ACGT" if a.CODES[b] & a.CODES[a.complement(c)]}


def test_strings():
    assert a.complement("AcGt-NRx") == "TgCa-NYx" and a.reverse_complement("AACG") == "CGTT"
    assert a.is_mixed_base("acgtRYSWKMBDHVN") and not a.is_mixed_base("ACU") and not a.is_mixed_base("É")
    assert a.matches("A", "R") and not a.matches("N", "N") and not a.matches("R", "R")
    assert a.motif_orientation("NNNNRG") == (False, 2) and a.motif_orientation("TTTNNNNN") == (True, 3) and a.motif_orientation("NNGNN") == (False, 3) and a.motif_orientation("NNN") == (False, 0)
    assert a.guide_of("ACGTNN", False, 2) == "ACGT" and a.guide_of("NNACGT", True, 2) == "ACGT"
    assert (a.trailing_n("ACNn"), a.ceil_div(7, 2), a.round_up(7, 4)) == (2, 4, 8)


def test_columns(spark):
    words = ["acgtRYn", "NNNRG", "TTTNNN", "", "AC-U", "GATTACA\n", None]
    frame = spark.createDataFrame([(w,) for w in words], "w string")
    first, length = a.motif_orientation_column(F.col("w"))
    rows = frame.select("w", a.complement_column(F.col("w")).alias("c"), a.reverse_complement_column(F.col("w")).alias("r"), a.is_mixed_base_column(F.col("w")).alias("m"), a.canonical_column(F.col("w")).alias("u"), first.alias("f"), length.alias("l")).collect()
    for r in rows:
        w = r["w"]
        if w is None:
            assert r["c"] is None and r["f"] is None
            continue
        assert (r["c"], r["r"], (r["f"], r["l"])) == (a.complement(w), a.reverse_complement(w), a.motif_orientation(w))
        assert r["m"] == a.is_mixed_base(w)
        assert r["u"].encode() == a.decode(a.encode(w))
    codes = spark.range(16).select(a.letter_column(F.col("id").cast("int")).alias("x")).collect()
    assert [c["x"] for c in codes] == [chr(x) for x in a.LETTER]


def plain_distance(p, t, same):
    row = [[0] * (len(t) + 1)] + [[i] + [0] * len(t) for i in range(1, len(p) + 1)]
    for i in range(1, len(p) + 1):
        for j in range(1, len(t) + 1):
            row[i][j] = min(row[i - 1][j - 1] + (not same(p[i - 1], t[j - 1])), row[i - 1][j] + 1, row[i][j - 1] + 1)
    return row[-1][-1]


def test_edit_distance(spark):
    draw = random.Random(1)
    takes = lambda p, t: p not in "ACGT" or p == t
    for _ in range(2000):
        p, t = ("".join(draw.choices("ACGTNR", k=draw.randint(0, n))) for n in (9, 14))
        assert edit_distance(match_table(p), t) == edit_distance(match_table(p.lower()), t.lower()) == plain_distance(p, t, takes)
    long = "".join(draw.choices("ACGT", k=64))
    assert edit_distance(match_table(long), "TTT" + long) == 0 and edit_distance(match_table(long), long[:30] + long[31:]) == 1
    with pytest.raises(ValueError):
        match_table("A" * 65)
    rows = spark.createDataFrame([("ACGT",), (None,), ("",)], "t string").select(edit_distance_column("ACG", F.col("t")).alias("d")).collect()
    assert [r["d"] for r in rows] == [1, None, 3]


def test_best_alignment(spark):
    draw = random.Random(2)
    for _ in range(1500):
        p, t = ("".join(draw.choices("ACGTN", k=draw.randint(0, n))) for n in (7, 10))
        found = best_alignment(p, t, 99, 9, 9)
        assert found.mismatches + found.dna_bulges + found.rna_bulges == plain_distance(p, t, loosely_equal)
        assert found.pattern_aligned.replace("-", "") == p and found.text_aligned.replace("-", "") == t[found.text_start :]
        if found.mismatches + found.dna_bulges + found.rna_bulges:
            assert best_alignment(p, t, found.mismatches + found.dna_bulges + found.rna_bulges - 1, 9, 9) is None
    assert vars(best_alignment("ACGT", "TTACGT", 0, 0, 0)) == {"ops": "MMMM", "pattern_aligned": "ACGT", "text_aligned": "ACGT", "text_start": 2, "mismatches": 0, "dna_bulges": 0, "rna_bulges": 0}
    assert best_alignment("ACGTT", "ACGT", 1, 1, 0) is None or best_alignment("ACGTT", "ACGT", 9, 1, 0).rna_bulges == 0
    rows = spark.createDataFrame([("TTACG",), (None,), ("",)], "t string").select(best_alignment_column("ACG", F.col("t"), 1, 1, 1).alias("f")).collect()
    assert rows[0]["f"]["ops"] == "MMM" and rows[1]["f"] is None and rows[2]["f"] is None


def test_code_rule():
    assert code_matches(15, 15) and code_matches(15, 1) and not code_matches(15, 0) and not code_matches(4, 15) and code_matches(12, 4) and not code_matches(12, 1)
    assert np.array_equal(a.COMPLEMENT[a.COMPLEMENT], np.arange(16))
