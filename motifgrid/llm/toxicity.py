"""Toxicity by maximum-scoring segments of token log-odds.

Training counts, over labelled documents, in how many toxic and how many clean
ones each word and each word prefix occurs. A feature's toxic share has a Dirichlet
prior centred on the share of its longest known prefix (the root: all documents),
so an unseen word has the log-odds of its longest known prefix. A token's score is
its log-odds, within `cap`, less a drift; a word that follows itself adds nothing. The linear-time scan of Ruzzo and Tompa finds all
disjoint maximal segments. The greatest segment of a clean document of n tokens
follows an extreme-value law, P(S < x) = exp(-K n exp(-lambda x)), fitted by maximum
likelihood to clean labelled documents that took no part in the counts; a segment is
significant by that law, and a logistic curve over the document's normalised
segments, fitted to the same rows, gives the score.

The model is fitted on a bounded sample of labelled rows (`max_labelled`, those with
the smallest hash of doc_id), and holds every feature of at least `min_documents` of
them: fewer say nothing that the prior doesn't. Every document is scored whole.

Defined results: a null or empty text has no tokens and the score of a document
without segments; a null doc_id counts as text '' in the hold-out. Repeated rows are
scored each; of repeated labels the greatest counts; null labels are left out. With
no labelled rows of either class every score is the share of toxic rows (0 without
rows). An empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, small_batches, table

WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class ToxicitySpec:
    max_labelled: int = 20_000
    min_documents: int = 4
    shortest_prefix: int = 3
    longest_prefix: int = 8
    strength: float = 4.0
    drift: float = 0.75
    cap: float = 6.0
    significance: float = 0.01


@dataclass
class ToxicityModel:
    """What a worker needs: log-odds by feature (a whole word ends with a blank), the law and the curve."""

    odds: dict[str, float]
    spec: ToxicitySpec = ToxicitySpec()
    decay: float = 1.0
    scale: float = 1.0
    curve: tuple[float, ...] = (-2.0, 0.0, 0.0)
    cache: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def weight(self, word: str) -> float:
        found = self.odds.get(word + " ")
        for n in range(min(len(word), self.spec.longest_prefix), self.spec.shortest_prefix - 1, -1) if found is None else ():
            if (found := self.odds.get(word[:n])) is not None:
                break
        return (found or 0.0) - self.spec.drift

    def weights(self, words: list[str]) -> np.ndarray:
        cache = self.cache
        if len(cache) > 300_000:
            cache.clear()
        for word in set(words):
            if word not in cache:
                cache[word] = self.weight(word)
        found = np.fromiter(map(cache.__getitem__, words), np.float64, len(words))
        repeats = [i for i in np.flatnonzero(found > 0).tolist() if i and words[i] == words[i - 1]]
        found[repeats] = -self.spec.drift
        return found

    def normalised(self, scores: np.ndarray, n: int) -> np.ndarray:
        return self.decay * scores - math.log(self.scale * max(n, 1))

    def p_value(self, score: float, n: int) -> float:
        return -math.expm1(-math.exp(min(50.0, -float(self.normalised(np.array([score]), n)[0]))))

    def traits(self, scores: np.ndarray, n: int) -> tuple[float, float]:
        """Of a document's segments: how far the best one stands out, and all of them together."""
        if not len(scores):
            return -3.0, 0.0
        z = self.normalised(scores, n)
        return float(np.clip(z.max(), -3.0, 20.0)), math.log1p(float(np.clip(z, 0, 20).sum()))

    def score(self, words: list[str]) -> tuple[float, int]:
        """Probability of label 1, and the number of significant segments."""
        scores = np.array([s for _, _, s in segments(self.weights(words))])
        best, together = self.traits(scores, len(words))
        limit = -math.log(-math.log1p(-self.spec.significance))
        x = self.curve[0] + self.curve[1] * best + self.curve[2] * together
        return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, x)))), int((self.normalised(scores, len(words)) >= limit).sum()) if len(scores) else 0


def tokens(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def segments(weights: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [begin, end) with their scores, in one pass over the positive weights.

    Between positive weights only the cumulative sum matters, so runs of others
    cost no step of their own.
    """
    places = np.flatnonzero(weights > 0)
    if not len(places):
        return []
    total = np.concatenate([[0.0], np.cumsum(weights)])
    left, right, begins, ends = [], [], [], []
    for i, low, high in zip(places.tolist(), total[places].tolist(), total[places + 1].tolist()):
        begin = i
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= low:
                j -= 1
            if j < 0 or right[j] >= high:
                break
            low, begin = left[j], begins[j]
            del left[j:], right[j:], begins[j:], ends[j:]
        left.append(low)
        right.append(high)
        begins.append(begin)
        ends.append(i + 1)
    return [(a, b, r - lo) for a, b, lo, r in zip(begins, ends, left, right)]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _features(text: str | None, spec: ToxicitySpec) -> set[str]:
    words = set(tokens(text))
    found = {w + " " for w in words}
    for n in range(spec.shortest_prefix, spec.longest_prefix + 1):
        found |= {w[:n] for w in words if len(w) >= n}
    return found


def _fit_law(best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """lambda and K of greatest segments of clean documents with n tokens, by maximum likelihood."""
    if len(best) < 2 or best.max() <= 0:
        return 1.0, 1e-3

    def slope(decay: float) -> float:
        w = n * np.exp(-decay * (best - best.min()))
        return 1 / decay - best.mean() + (w @ best) / w.sum()

    low, high = 1e-3, 50.0
    for _ in range(80):
        mid = math.sqrt(low * high)
        low, high = (mid, high) if slope(mid) > 0 else (low, mid)
    return low, float(len(best) / (n * np.exp(-low * best)).sum())


def _fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        step = np.linalg.solve(a.T * (p * (1 - p)) @ a + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
        w = w + step / max(1.0, np.abs(step).max() / 3)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def _share_model(counts: list[tuple[str, int, int]], toxic: int, clean: int, spec: ToxicitySpec) -> dict[str, float]:
    """Log-odds by feature; those that repeat what their prefix says are left out."""
    base = (toxic + 1) / (toxic + clean + 2)
    logit = lambda p: math.log(p / (1 - p))
    share: dict[str, float] = {}
    odds: dict[str, float] = {}
    for name, bad, seen in sorted(counts, key=lambda c: (len(c[0]), c[0])):
        at = next((name[:n] for n in range(min(len(name) - 1, spec.longest_prefix), spec.shortest_prefix - 1, -1) if name[:n] in share), None)
        prior = base if at is None else share[at]
        share[name] = (bad + spec.strength * prior) / (seen + spec.strength)
        own, before = logit(share[name]) - logit(base), logit(prior) - logit(base)
        if abs(own - before) >= 0.1 or max(own, before) > spec.drift:
            odds[name] = max(-spec.cap, min(spec.cap, own))
        else:
            share[name] = prior
    return odds


def train(docs: DataFrame, labels: DataFrame, spec: ToxicitySpec = ToxicitySpec()) -> ToxicityModel:
    """A model from docs(doc_id, text) and labels(doc_id, toxic), without the held-out rows."""
    release(docs.sparkSession)
    small_batches(docs.sparkSession, 256)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(spec.max_labelled)
    # At most max_labelled pairs of numbers.
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").withColumn("fits", F.xxhash64("doc_id", F.lit("calibration")) % 4 == 0)

    def count(batches):
        found, seen = Counter(), [0, 0]

        def flush():
            names = sorted({name for name, _ in found})
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([found[name, 1] for name in names], pa.int64()), pa.array([found[name, 1] + found[name, 0] for name in names], pa.int64())], names=["name", "bad", "seen"])

        for batch in batches:
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
                toxic = int(toxic > 0)
                seen[toxic] += 1
                found.update((name, toxic) for name in _features(text, spec))
            if len(found) > 400_000:
                yield flush()
                found.clear()
        found.update({("", 0): seen[0], ("", 1): seen[1]})
        yield flush()

    counts = rows.where(~F.col("fits")).mapInArrow(count, "name string, bad long, seen long").groupBy("name").agg(F.sum("bad").alias("bad"), F.sum("seen").alias("seen"))
    counts = counts.where((F.col("seen") >= spec.min_documents) | (F.col("name") == "")).toArrow()  # of at most max_labelled texts
    counted = list(zip(counts["name"].to_pylist(), counts["bad"].to_pylist(), counts["seen"].to_pylist()))
    toxic = sum(bad for name, bad, _ in counted if not name)
    clean = sum(seen - bad for name, bad, seen in counted if not name)
    model = ToxicityModel(_share_model([c for c in counted if c[0]], toxic, clean, spec), spec)

    def measured(of) -> pa.Table:
        """toxic and two numbers, of(words), for each calibration row."""

        def run(batches):
            for batch in batches:
                out = [(int(toxic > 0), *of(tokens(text))) for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.float64(), pa.float64()))], names=["toxic", "x", "y"])

        return rows.where("fits").mapInArrow(run, "toxic int, x double, y double").toArrow()

    def scores(own: ToxicityModel, words: list[str]) -> np.ndarray:
        return np.array([s for _, _, s in segments(own.weights(words))])

    context = docs.sparkSession.sparkContext
    sent = context.broadcast(model)
    found = measured(lambda words: (max(len(words), 1), max(scores(sent.value, words), default=0.0)))
    y, n, best = (found[c].to_numpy().astype(float) for c in ("toxic", "x", "y"))
    if not len(y) or y.min() == y.max():
        share = (toxic + float(y.sum())) / max(1, toxic + clean + len(y))
        model.curve = (math.log(max(share, 1e-9) / max(1 - share, 1e-9)), 0.0, 0.0)
        return model
    model.decay, model.scale = _fit_law(best[y == 0], n[y == 0])
    lawful = context.broadcast(model)
    found = measured(lambda words: lawful.value.traits(scores(lawful.value, words), len(words)))
    model.curve = _fit_curve(np.column_stack([found["x"].to_numpy(), found["y"].to_numpy()]), found["toxic"].to_numpy().astype(float))
    return model


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, predicted and the number of significant passages for each row of docs(doc_id, text)."""
    small_batches(docs.sparkSession, 256)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = sent.value
        for batch in batches:
            found = [own.score(tokens(t)) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([s for s, _ in found], pa.float64()), pa.array([int(s >= 0.5) for s, _ in found], pa.int32()), pa.array([k for _, k in found], pa.int32())], names=["doc_id", "score", "predicted", "passages"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int, passages int")


def reject_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows, with all their columns, whose score is under one half."""
    small_batches(docs.sparkSession, 256)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = sent.value
        for batch in batches:
            yield batch.filter(pa.array([own.score(tokens(t))[0] < 0.5 for t in batch["text"].to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxic_passages(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Every significant passage: doc_id, its span in code points, text, score and p-value."""
    small_batches(docs.sparkSession, 256)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = sent.value
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                spans = [m.span() for m in WORD.finditer(text or "")]
                words = [text[a:b].lower() for a, b in spans]
                for a, b, score in segments(own.weights(words)):
                    if (p := own.p_value(score, len(words))) <= own.spec.significance:
                        out.append((doc, spans[a][0], spans[b - 1][1], text[spans[a][0] : spans[b - 1][1]], score, p))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64()))], names=["doc_id", "begin", "end", "passage", "score", "p_value"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, begin int, end int, passage string, score double, p_value double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, scored."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "passages")
