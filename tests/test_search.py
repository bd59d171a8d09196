import random

import pytest

from motifgrid.operators.bulge import shapes
from motifgrid.operators.search import find_sites, search, summary
from motifgrid.operators.tiling import tile
from motifgrid.plans.spec import ArgumentError, SearchSpec

from . import brute

MIXED = "ACGTACGTACGTACGTNRYKacgtn-X"


def genome(draw, letters, sizes):
    return [(f"c{i % 5}", "".join(draw.choices(letters, k=n))) for i, n in enumerate(sizes)]


def found(spark, rows, spec, size=1 << 18):
    frame = spark.createDataFrame([(n, s, 1) for n, s in rows], "chr_name string, seq string, n int")
    return sorted(map(tuple, search(frame, spec, size).collect()))


MISMATCH = [
    SearchSpec("NNNNNRG", ("ACGTNNN", "TTGCANN"), 2),
    SearchSpec("TTNNNNNN", ("NNACGRYA",), 3),
    SearchSpec("NNNNN", ("ACGTN", "acgtn", "ACGTN"), 1),
    SearchSpec("NNNNN", ("NNANN",), 1, strict_gate=False),
    SearchSpec("NNNN", ("ACGT",), 9),
    SearchSpec("NNNNNNNNNNN", ("ACGTRCGTACN", "AAAANAAAAAA"), 3),
    SearchSpec("NNNVNN", ("BDHVSW",), 2),
    SearchSpec("N" * 70 + "GG", ("ACGTN" * 14 + "NN",), 50),
]


@pytest.mark.parametrize("spec", MISMATCH, ids=range(len(MISMATCH)))
def test_mismatches_against_loops(spark, spec):
    draw = random.Random(spec.length)
    rows = genome(draw, MIXED, [400, 0, 3, 80, 81, 64, 5, 1])
    expected = brute.sites(rows, spec)
    assert expected and found(spark, rows, spec) == expected
    assert found(spark, rows, spec, size=7) == expected


BULGE = [
    SearchSpec("NNNNNNGG", ("ACGTANNN",), 1, 1, 1),
    SearchSpec("TTNNNNNN", ("NNACGTCA",), 4, 1, 0),
    SearchSpec("NNNNNN", ("ACNGTR", "TTTTTT"), 2, 0, 1),
    SearchSpec("NNNNNRG", ("acgtNNN",), 1, 2, 2),
    SearchSpec("NRNNNNN", ("ACGTACG",), 1, 1, 1),
    SearchSpec("NNNN", ("ACGT",), 0, 0, 4),
    SearchSpec("NNNNNNN", ("NNACGNN",), 1, 2, 1),
]


@pytest.mark.parametrize("spec", BULGE, ids=range(len(BULGE)))
def test_bulges_against_loops(spark, spec):
    draw = random.Random(spec.length + 100)
    rows = genome(draw, "ACGTACGTACGTACGTACGTNRacgtn-", [150, 0, 3, 40, 41, 9, 5, 1])
    expected = brute.sites(rows, spec)
    assert expected and found(spark, rows, spec) == expected
    assert found(spark, rows, spec, size=5) == expected


def test_no_site_spans_two_sequences_and_ends_count(spark):
    spec = SearchSpec("NNNNNN", ("ACGTGG",), 0)
    rows = [("a", "ACGTGGTTACG"), ("b", "TGGTTTACGTGG"), ("a", "ACGTG")]
    assert [r[3:6] for r in found(spark, rows, spec)] == [("a", 0, "+"), ("b", 6, "+")]


def test_equal_and_palindromic_patterns_repeat(spark):
    rows = [("a", "TTACGCGTTT")]
    assert len(found(spark, rows, SearchSpec("NNNNNN", ("ACGCGT",), 0))) == 2
    assert len(found(spark, rows, SearchSpec("NNNNNN", ("ACGCGT", "ACGCGT"), 0))) == 4


def test_tiles_cover_each_sequence_once(spark):
    rows = [("a", "A" * 10), ("b", ""), ("c", None), ("a", "CCC")]
    frame = spark.createDataFrame(rows, "chr_name string, seq string")
    tiles = tile(frame, overlap=2, size=4).collect()
    assert sorted((t["chr_name"], t["tile_start"], t["own"], bytes(t["seq"])) for t in tiles) == [("a", 0, 3, b"CCC"), ("a", 0, 4, b"AAAAAA"), ("a", 4, 4, b"AAAAAA"), ("a", 8, 2, b"AA")]
    assert len({t["chr_ord"] for t in tiles}) == 2
    assert tile(frame, spread=3).rdd.getNumPartitions() == 3


def test_plan_has_no_shuffle(spark):
    frame = spark.createDataFrame([("a", "ACGT")], "chr_name string, seq string")
    for spec in (MISMATCH[0], BULGE[0]):
        plan = search(frame, spec)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "MapInArrow" in plan


def test_numbers_of_shapes():
    assert len(shapes("A" * 24 + "NNN", 1, 1)) == 600
    assert shapes("ACG", 0, 0) == ["MMM"]
    assert all(s.startswith("M") for s in shapes("NNNACG", 1, 0))


def test_summary(spark):
    spec = SearchSpec("NNN", ("ACG", "TTT"), 1)
    rows = [("a", "ACGTTTACG")]
    frame = spark.createDataFrame(rows, "chr_name string, seq string")
    total = sum(r["sites"] for r in summary(find_sites(frame, spec), spec).collect())
    assert total == len(brute.sites(rows, spec)) > 0


def test_empty_genome(spark):
    frame = spark.createDataFrame([], "chr_name string, seq string")
    assert search(frame, MISMATCH[0]).count() == 0 and search(frame, BULGE[0]).count() == 0


@pytest.mark.parametrize("bad", [("", ("",), 1), ("NN", (), 1), ("NNU", ("ACG",), 1), ("NN", ("ACG",), 1), ("NN", ("AX",), 1), ("NN", ("AC",), -1)])
def test_bad_specs(bad):
    with pytest.raises(ArgumentError):
        SearchSpec(*bad)


def test_longest_bulge_pattern():
    SearchSpec("N" * 65, ("A" * 65,), 1)
    SearchSpec("N" * 64, ("A" * 64,), 1, 1)
    with pytest.raises(ArgumentError):
        SearchSpec("N" * 65, ("A" * 65,), 1, 1)
