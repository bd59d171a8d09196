import random
from collections import Counter
from fractions import Fraction

import pytest

from motifgrid.llm.mixing import MixSpec, mix, place, schedule


def lags(weights, slots):
    """The greatest deviation from the target share, over all slots before a source has run out, by plain fractions."""
    total = sum(Fraction(w) for w in weights.values())
    end = min(own[-1] for own in slots.values()) + 1
    by_slot = {t: k for k, own in slots.items() for t in own}
    had, worst = Counter(), Fraction(0)
    for t in range(end):
        had[by_slot[t]] += 1
        worst = max([worst, *(abs(had[k] - Fraction(w) / total * (t + 1)) for k, w in weights.items())])
    return worst


def test_blocks_keep_their_windows():
    draw = random.Random(1)
    for _ in range(150):
        weights = {f"s{i}": draw.random() ** 3 + 1e-3 for i in range(draw.randint(1, 12))}
        slots = schedule(weights, {k: draw.randint(1, 60) for k in weights})
        total = sum(map(Fraction, weights.values()))
        taken = [t for own in slots.values() for t in own]
        assert len(set(taken)) == len(taken)
        for k, own in slots.items():
            w = Fraction(weights[k]) / total
            assert all(j / w // 1 <= t < -(-(j + 1) / w // 1) for j, t in enumerate(own))
        assert lags(weights, slots) < 1


def test_small_and_large_weights_are_kept_exactly():
    weights = {"a": 0.9995, "b": 0.00049, "c": 0.00001}
    slots = schedule(weights, {"a": 300_000, "b": 200, "c": 4})
    assert lags(weights, slots) < 1
    assert sum(t < 200_000 for t in slots["c"]) in (1, 2, 3) and abs(sum(t < 200_000 for t in slots["b"]) - 98) <= 1
    third = {f"s{i}": (100_000 if i == 0 else 10_526) ** 0.5 for i in range(20)}
    assert lags(third, schedule(third, {k: 2000 for k in third})) < 1


def brute(counts, weights, size):
    """The sources of all positions, slot by slot: whoever of the released has the earliest deadline, by plain fractions."""
    total = sum(Fraction(weights[k]) for k in counts)
    w = {k: Fraction(weights[k]) / total for k in counts}
    done, left, out, slot = Counter(), dict(counts), [], 0
    while any(left.values()):
        able = [(-(-(done[k] + 1) / w[k] // 1), k is None, str(k), k) for k in counts if left[k] and done[k] / w[k] // 1 <= slot]
        if able:
            k = min(able, key=lambda x: x[:3])[3]
            n = min(size, left[k])
            out += [k] * n
            left[k] -= n
            done[k] += 1
        slot += 1
    return out


@pytest.mark.parametrize("group", [10_000, 7])
def test_places(spark, group):
    draw = random.Random(5)
    counts = {"a": 200, "b": 37, None: 20, "c": 1}
    rows = [(draw.randint(0, 40), k, "x", 5) for k, n in counts.items() for _ in range(n)]
    rows[3] = (None, rows[3][1], "x", 5)
    frame = spark.createDataFrame(rows, "doc_id long, source string, mix_name string, hash int")
    weights = {"a": 0.5, "b": 0.3, None: 0.15, "c": 0.05, "absent": 1.0}
    spec = MixSpec(block=4, group=group)
    found = place(frame, weights, spec).orderBy("mix_position").collect()
    assert [r["mix_position"] for r in found] == list(range(len(rows)))
    assert [r["source"] for r in found] == brute(counts, weights, 4)
    for k, n in counts.items():
        assert sorted(r["mix_rank"] for r in found if r["source"] == k) == list(range(n))
    mixed = mix(frame, weights, spec)
    assert mixed.columns == frame.columns
    assert [r["source"] for r in mixed.collect()] == [r["source"] for r in found]
    assert Counter(map(tuple, mixed.collect())) == Counter(rows)


def test_blocks_grow_so_that_the_schedule_is_bounded(spark):
    spec = MixSpec(block=2, max_blocks=10)
    assert spec.rows_a_block(20) == 2 and spec.rows_a_block(101) == 11
    frame = spark.range(100).selectExpr("id AS doc_id", "IF(id % 4 = 0, 'a', 'b') AS source")
    found = place(frame, None, spec).orderBy("mix_position").collect()
    assert [r["source"] for r in found] == brute({"a": 25, "b": 75}, {"a": 5.0, "b": 75**0.5}, 10)
    assert max(r["mix_block"] for r in found) == 7


def test_empty_table_and_bad_weights(spark):
    empty = spark.createDataFrame([], "doc_id long, source string")
    assert place(empty).count() == 0 and mix(empty).count() == 0
    frame = spark.createDataFrame([(1, "a")], "doc_id long, source string")
    for bad in ({}, {"a": 0.0}, {"a": float("nan")}, {"a": float("inf")}):
        with pytest.raises(ValueError):
            place(frame, bad)
    with pytest.raises(ValueError):
        place(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, source string"), None, MixSpec(max_sources=1))
    with pytest.raises(ValueError):
        place(frame.selectExpr("*", "1 AS mix_rank"))


def test_the_query_against_the_plain_schedule(spark):
    from motifgrid.llm.mixing import op3_pfair_mixing

    found = op3_pfair_mixing(spark, "/root/testdata/sf0.001").orderBy("mix_position").collect()
    counts = Counter(r["source"] for r in found)
    assert [r["source"] for r in found] == brute(counts, {k: n**0.5 for k, n in counts.items()}, 16)
