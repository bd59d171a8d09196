import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from motifgrid.llm.toxicity import ToxicitySpec, held_out, reject_toxic, score_documents, segments, tokens, toxic_passages, train


def plain_segments(w):
    """Maximal segments by their definition: the greatest one (the shortest of those), then left and right of it."""
    best, total = None, np.concatenate([[0], np.cumsum(w)])
    for a in range(len(w)):
        for b in range(a + 1, len(w) + 1):
            s = total[b] - total[a]
            if s > 1e-12 and (best is None or s > best[2] + 1e-12 or (abs(s - best[2]) < 1e-12 and b - a < best[1] - best[0])):
                best = (a, b, s)
    if not best:
        return []
    a, b, _ = best
    return plain_segments(w[:a]) + [best] + [(x + b, y + b, z) for x, y, z in plain_segments(w[b:])]


def test_segments():
    draw = random.Random(3)
    for _ in range(500):
        w = np.array([draw.uniform(-1, 1) for _ in range(draw.randint(0, 14))])
        found, plain = segments(w), plain_segments(w)
        assert [x[:2] for x in found] == [x[:2] for x in plain]
        assert np.allclose([x[2] for x in found], [x[2] for x in plain])


def corpus(draw, n=600):
    clean = ["".join(draw.choices("abdeghimnorstu", k=draw.randint(2, 8))) for _ in range(300)]
    bad = ["zlorp", "vexkot", "grumblix"]
    rows, labels = [], []
    for i in range(n):
        toxic = draw.random() < 0.25
        words = draw.choices(clean, k=draw.randint(5, 200))
        for _ in range(draw.randint(2, 5) if toxic else 0):
            words.insert(draw.randint(0, len(words)), draw.choice(bad + ["xyz" + draw.choice(clean)]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_accuracy_on_held_out_rows(spark):
    rows, labels = corpus(random.Random(1))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = train(docs, known)
    found = score_documents(docs, model).join(known, "doc_id").withColumn("out", held_out(F.col("doc_id"))).collect()
    out = [r for r in found if r["out"]]
    assert {r["doc_id"] for r in out} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["predicted"] == r["toxic"] for r in out) >= 0.97 * len(out)
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in found)
    # held-out labels change nothing
    flipped = known.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert train(docs, flipped).curve == model.curve
    passages = toxic_passages(docs, model).collect()
    text = dict(rows)
    assert passages and all(text[p["doc_id"]][p["begin"] : p["end"]] == p["passage"] and p["p_value"] <= 0.01 for p in passages)
    assert sum(any(w in p["passage"] for w in ("zlorp", "vexkot", "grumblix", "xyz")) for p in passages) >= 0.95 * len(passages)
    kept = {r["doc_id"] for r in reject_toxic(docs.withColumn("score", F.lit("x")), model).collect()}
    assert kept == {r["doc_id"] for r in found if not r["predicted"]}


def test_edges(spark):
    rows, labels = corpus(random.Random(2), 200)
    odd = [(None, "abc"), (7000, None), (7001, ""), (7002, "zlorp " * 20_000), (0, rows[0][1])]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string")
    known = spark.createDataFrame([*labels, *labels[:5], (None, 1), (3, None)], "doc_id long, toxic int")
    model = train(docs, known)
    found = score_documents(docs, model).collect()
    assert len(found) == len(rows) + len(odd)
    score = {r["doc_id"]: r["score"] for r in found}
    assert score[7000] == score[7001] and 0 <= score[7000] < 0.5 and score[7002] >= 0.5
    assert sum(r["doc_id"] == 0 for r in found) == 2
    empty = known.limit(0)
    assert max(r["score"] for r in score_documents(docs, train(docs, empty)).collect()) < 1e-6
    one_class = train(docs, known.where("toxic = 0"))
    assert max(r["score"] for r in score_documents(docs, one_class).collect()) < 0.01
    assert score_documents(docs.limit(0), model).count() == 0
    assert train(docs, known, ToxicitySpec(max_labelled=50)).odds


def test_tokens():
    assert tokens("Éa b1c_d x") == ["éa", "b", "c", "d", "x"] and tokens(None) == []
