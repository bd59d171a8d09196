import math
import random

import pytest
from pyspark.sql import functions as F

from motifgrid.llm import topk
from motifgrid.llm.topk import TopK, top_k

from .oracle import assert_same


def brute(rows, k):
    v = [(i, [math.floor(64 * x) for x in e]) for i, e in rows]
    out = []
    for q, x in v:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in v if i != q)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("spec", [TopK(k=5), TopK(k=5, queries_a_block=3, candidates_a_group=40, candidates_a_block=8), TopK(k=500, candidates_a_block=16)])
def test_against_brute_force(spark, spec):
    draw = random.Random(4)
    rows = [(i, [draw.gauss(0, 1) * (1 + i % 5) for _ in range(6)]) for i in range(200)]
    for i in range(60, 90):
        rows[i] = (i, rows[60][1])  # many equal vectors: ties go to the smaller id
    bad = [(1000, None), (1020, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1040, [float("nan")] * 6), (1060, [float("inf")] * 6), (1080, []), (None, [1.0] * 6), (1100, [1.0, 2.0])]
    frame = spark.createDataFrame([(i, e, 1) for i, e in rows + bad], "vec_id long, embedding array<double>, score int")
    found = top_k(frame, F.col("vec_id") % 20 == 0, spec).collect()
    assert sorted(map(tuple, found)) == brute(rows, spec.k)


def test_short_vectors_and_served_queries_are_not_dealt(spark, monkeypatch):
    """Lengths that fall fast: most queries are done after the longest band."""
    draw, dealt = random.Random(8), []
    rows = [(i, [draw.gauss(0, 1) * 100 * 0.98**j for _ in range(5)]) for j, i in enumerate(draw.sample(range(600), 600))]
    second = topk.second_round

    def watched(*args):
        dealt.extend(frame.count() for frame in second(*args))
        return second(*args)

    monkeypatch.setattr(topk, "second_round", watched)
    spec = TopK(k=5, queries_a_block=4, candidates_a_group=50, candidates_a_block=16)
    found = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, spec).collect()
    assert sorted(map(tuple, found)) == brute(rows, spec.k)
    asked, offered = dealt
    assert asked < 30 * 11 / 4 and offered < 550 * 8 / 4


def test_one_length_for_all(spark):
    """No band tells such vectors apart; its parts are dealt by id."""
    rows = [(i, [1.0, 2.0, -1.0] if i % 3 else [2.0, -1.0, 1.0]) for i in range(120)]
    spec = TopK(k=4, queries_a_block=2, candidates_a_group=25)
    found = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, spec).collect()
    assert sorted(map(tuple, found)) == brute(rows, spec.k)


def test_empty_and_alone(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(empty, F.col("vec_id") % 20 == 0).count() == 0
    alone = spark.createDataFrame([(20, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert top_k(alone, F.col("vec_id") % 20 == 0).count() == 0


def test_vectors_meet_those_of_their_length(spark):
    draw = random.Random(6)
    rows = [(i, [draw.gauss(0, 1) for _ in range(3 if i % 4 else 2)]) for i in range(100)]
    found = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, TopK(k=4)).collect()
    assert sorted(map(tuple, found)) == sorted(brute([r for r in rows if r[0] % 4], 4) + brute([r for r in rows if not r[0] % 4], 4))


def test_the_query_equals_its_sql(spark):
    assert assert_same(spark, "/root/testdata/sf0.001", "op4_exact_top_k") > 0
