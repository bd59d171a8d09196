import random

import numpy as np
import pyarrow as pa
import pytest

from motifgrid.llm import setjoin, shingles
from motifgrid.llm.components import connected_components
from motifgrid.llm.setjoin import JoinSpec, linked_edges, minwise, near_duplicates

from . import brute
from .oracle import assert_same


def test_shingle_sets():
    draw = random.Random(1)
    texts = [None, "", " ", "a", "A b", "a b c d e f g"] + ["".join(draw.choices(["a ", "b ", "É", "c\n", "  ", "Z", "\x0b", "\x1c"], k=draw.randint(0, 80))) for _ in range(400)]
    prints = {}
    for column in (pa.array(texts), pa.concat_arrays([pa.array(["zz top"]), pa.array(texts)]).slice(1)):
        for text, own in zip(texts, shingles.sets_of(column), strict=True):
            assert len(own) == len(brute.shingles(text))
            assert prints.setdefault(brute.shingles(text), shingles.fingerprint(own)) == shingles.fingerprint(own)
    assert len(set(prints.values())) == len(prints)


def test_a_text_of_many_blocks_has_the_same_set(monkeypatch):
    draw = random.Random(3)
    text = "".join(draw.choices(["ab ", "Cd\n", "é", "x" * 30, "   "], k=3000))
    whole = next(shingles.sets_of(pa.array([text])))
    monkeypatch.setattr(shingles, "BLOCK_BYTES", 64)
    assert np.array_equal(whole, next(shingles.sets_of(pa.array([text]))))
    assert [len(s) for s in shingles.sets_of(pa.array([text, "a", None, "b" * 5000]))] == [len(whole), 1, 0, 1]


def test_components(spark):
    draw = random.Random(2)
    edges = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(160)] + [(k, k + 1) for k in range(400, 450)] + [(500, k) for k in range(501, 600)]
    found = connected_components(spark.createDataFrame([*edges, (None, 1), (7, 7), *edges[:5]], "a long, b long"))
    own = {r["node"]: r["root"] for r in found.collect()}
    assert found.count() == len(own)
    expected = brute.components({n for e in edges for n in e}, edges)
    assert own == {n: r for n, r in expected.items() if n in own}
    assert all(n in own or sum(n in e for e in edges if e[0] != e[1]) == 0 for n in expected)
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def corpus(draw, families=12):
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [draw.choice(vocabulary) for _ in range(40)]
    texts = []
    for _ in range(families):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([3, 8, 60, 150]))]
        for _ in range(draw.randint(1, 9)):
            own = brute.variant(draw, base, draw.choice([0, 0.004, 0.02, 0.05]), vocabulary)
            texts.append(" ".join(own + (passage if draw.random() < 0.5 else [])))
    return texts + texts[:3] + [None, "", " \n", None, "", "Solo", "solo"]


@pytest.mark.parametrize("spec", [JoinSpec(), JoinSpec(leaf=4, levels=3, sketch_block=7, block=5, chunk=2)])
def test_near_duplicates_against_brute_force(spark, spec):
    draw = random.Random(7)
    rows = list(enumerate(corpus(draw)))
    draw.shuffle(rows)
    frame = spark.createDataFrame([(i, t, 1, b"x", 2) for i, t in rows], "doc_id long, text string, n int, class binary, n_shingles int").repartition(5)
    found = near_duplicates(frame, spec).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute.near_duplicates(rows)
    assert len(found) == len(rows) and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_a_large_family_in_blocks(spark):
    draw = random.Random(8)
    vocabulary = [f"w{k}" for k in range(3000)]
    base = [draw.choice(vocabulary) for _ in range(70)]
    rows = [(i, " ".join(brute.variant(draw, base, 0.022, vocabulary))) for i in range(150)]
    expected = brute.near_duplicates(rows)
    assert 1 < len({c for _, c in expected.values()}) < 100
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), JoinSpec(leaf=16, sketch_block=40, block=32)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == expected


def test_null_and_repeated_ids(spark):
    long = " ".join(f"a{k}" for k in range(50))
    huge = " ".join(str(k) for k in range(100_000))
    rows = [(20, huge), (21, huge + " more")]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == [(20, 20), (21, 20)]
    rows = [(None, long), (5, long), (3, long), (3, long), (9, "one two three four five six"), (3, "one two three four five six"), (None, None)]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in found if r["doc_id"] is not None) == [(3, 3, True)] * 3 + [(5, 3, False), (9, 3, False)]
    assert all(r["component_id"] is None and not r["kept"] for r in found if r["doc_id"] is None)
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_trees_reach_the_recall():
    spec = JoinSpec()
    assert spec.trees * (1 + spec.pool) <= setjoin.SKETCH and 60 <= spec.least_agreement < 96
    # Pairs at the threshold whose nodes branch at all levels: each coordinate agrees by chance, a node picks from its tree's pool.
    draw, n, missed = np.random.default_rng(1), 40_000, 1.0
    agree = draw.random((n, spec.pool)) < spec.similarity
    alive = [np.flatnonzero(draw.random(n) < spec.similarity)]
    for _ in range(spec.levels):
        below = [at[agree[at, draw.integers(0, spec.pool, len(at))]] for at in alive for _ in range(spec.branches)]
        alive = below
    met = np.unique(np.concatenate(alive)).size / n
    assert (1 - met) ** spec.trees < 1e-4


def test_the_query_equals_its_sql(spark):
    assert_same(spark, "/root/testdata/sf0.001", "op5_minhash_near_dedup")


def test_links_of_a_block():
    draw = np.random.default_rng(1)
    for _ in range(30):
        bases = [draw.choice(5000, draw.integers(5, 80), replace=False) for _ in range(3)]
        sets = []
        for _ in range(24):
            own = bases[draw.integers(3)].copy()
            own[draw.random(len(own)) < draw.choice([0, 0.05, 0.15])] += 7000
            sets.append(np.unique(own).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            sets[-1].sort()
        sketch = minwise(sets).astype(np.uint8)
        root = draw.integers(0, 20, len(sets))
        first, second = np.arange(0, 16), np.arange(8, 24)
        edges = linked_edges(sets, sketch, root, first, second, JoinSpec())
        plain = []
        for x in first:
            for y in second:
                shared = len(np.intersect1d(sets[x], sets[y]))
                if x != y and 4 * shared >= 3 * (len(sets[x]) + len(sets[y]) - shared):
                    plain.append((x, y))
        same = [(a, b) for a in range(24) for b in range(a) if root[a] == root[b]]
        assert set(edges) <= set(plain) and len(edges) < 24
        assert brute.components(range(24), edges + same) == brute.components(range(24), plain + same)
