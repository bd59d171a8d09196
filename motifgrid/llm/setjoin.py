"""MinHash near-duplicates by a chosen-path set similarity join.

Documents are sets of word shingles; documents with the same set are one class.
Every tree sorts the classes into nodes by the minwise token of a coordinate of its
own. Nodes of more than `leaf` classes branch, level by level: each chooses `branches`
further coordinates of its tree, by its own number, and a class goes down one child for
each of them. What still stands together after `levels` levels agrees on nearly all
coordinates of the tree.
Independent trees are repeated until a pair at the threshold shares a leaf with the
target recall. Nodes of one class are dropped at every level.

Leaves are compared exhaustively, in an order that spares pairs whose outcome
changes nothing. First every class is compared with two pivots of its leaf; links,
confirmed on the full sets, join classes into components. Then all pairs of a leaf
that lie in different components are compared by 128-coordinate sketches and the
sets' sizes, which rule out most; what they can't rule out forms families, and within
a family every pair of different components is compared on the full sets, read again
from the whole texts. Leaves and families that are large are compared in blocks, and
give edges that connect what is linked, never all pairs; a pair within one component
is never needed.

Defined results: a null or empty text, or one of blanks alone, has an empty set and
is linked with nothing. Rows with the same set are linked. Rows that share a doc_id
are one document, linked with what any of them is linked with. A row with a null
doc_id takes no part: its component is null and it isn't kept. An empty table gives
an empty one. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, in_blocks, lean, materialise, sieve, small_batches, sorted_groups, table
from .components import connected_components
from .shingles import WORDS, fingerprint, mix, sets_of

SKETCH = 128


@dataclass(frozen=True)
class JoinSpec:
    """numerator / denominator: least similarity of a link. recall: of a pair at that similarity, by the trees."""

    words: int = WORDS
    numerator: int = 75
    denominator: int = 100
    recall: float = 1 - 1e-6
    leaf: int = 256
    branches: int = 2
    #: Levels at which a node branches that still holds more than `leaf` classes. Near copies agree at every
    #: level, so each more doubles how often a large group of them is compared with pivots.
    levels: int = 2
    #: Coordinates that each tree has of its own, beside its root's, for its nodes to choose from.
    pool: int = 8
    #: Standard errors by which a sketch may fall short of the threshold.
    slack: float = 5.5
    #: Members that are compared with a set at a time; classes of a block that meets another, by sketches and by texts.
    chunk: int = 256
    sketch_block: int = 2048
    block: int = 256

    @property
    def similarity(self) -> float:
        return self.numerator / self.denominator

    @property
    def trees(self) -> int:
        """So many that a pair at the threshold is missed with probability 1 - recall, if its nodes branch at all levels."""
        reach = 1.0
        for _ in range(self.levels):
            reach = 1 - (1 - self.similarity * reach) ** self.branches
        return max(1, math.ceil(math.log(1 - self.recall) / math.log(1 - self.similarity * reach)))

    @property
    def least_agreement(self) -> int:
        return math.floor(SKETCH * self.similarity - self.slack * math.sqrt(SKETCH * self.similarity * (1 - self.similarity)))

    def may_link(self, small: int, large: int) -> bool:
        return self.denominator * small >= self.numerator * large

    def linked(self, shared: int, a: int, b: int) -> bool:
        return a > 0 and b > 0 and self.denominator * shared >= self.numerator * (a + b - shared)


_SALTS = mix(np.arange(1, SKETCH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """SKETCH minwise values, 32 bits each, for every set; those of empty sets mean nothing."""
    out = np.zeros((len(sets), SKETCH), np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        joined = np.concatenate([sets[i] for i in full])
        starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
        high = (joined >> np.uint64(32)).astype(np.uint32) ^ joined.astype(np.uint32)
        spread = np.empty_like(high)
        for k in range(SKETCH):
            salt = int(_SALTS[k])
            np.bitwise_xor(high, np.uint32(salt >> 32), out=spread)
            np.multiply(spread, np.uint32((salt | 1) & 0xFFFFFFFF), out=spread)
            out[full, k] = np.minimum.reduceat(spread, starts)
    return out


def signatures(docs: DataFrame, spec: JoinSpec = JoinSpec()) -> DataFrame:
    """(doc_id, n_shingles, class, sketch, tokens) for docs(doc_id, text); class is a fingerprint of the set, null if it is empty."""
    small_batches(docs.sparkSession, 256)
    kept = spec.trees * (1 + spec.pool)
    assert kept <= SKETCH, "the trees need more coordinates than there are"

    def run(batches):
        for batch in batches:
            sets = list(sets_of(batch["text"], spec.words))
            values = np.concatenate([minwise(sets[a : a + 64]) for a in range(0, len(sets), 64)]) if sets else np.zeros((0, SKETCH), np.uint32)
            small = values.astype(np.uint8)  # low bits: the high ones of a minimum are nearly always 0
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"],
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([fingerprint(s) if len(s) else None for s in sets], pa.binary()),
                pa.array([row.tobytes() for row in small], pa.binary()),
                pa.array(list(values[:, :kept].view(np.int32)), pa.list_(pa.int32())),
            ], names=["doc_id", "n_shingles", "class", "sketch", "tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, n_shingles long, class binary, sketch binary, tokens array<int>")


def leaves(classes: DataFrame, spec: JoinSpec, most: int | None = None) -> DataFrame:
    """(node, tree, class, n) of all leaves with more than one class, of all trees. classes has class and tokens; most: a bound of its rows."""
    rows = None if most is None else most * spec.trees
    width = 1 + spec.pool
    trees = F.explode(F.sequence(F.lit(0), F.lit(spec.trees - 1)))
    roots = classes.select("class", "tokens", trees.alias("tree")).select(F.xxhash64("tree", F.get("tokens", F.col("tree") * width)).alias("node"), "tree", "class")
    now, done = _shared(roots, rows), []
    for level in range(spec.levels):
        large = now.where(F.col("n") > spec.leaf)
        if large.limit(1).count() == 0:
            break
        done.append(now.where(F.col("n") <= spec.leaf))
        picks = [(F.col("tree") * width + 1 + F.pmod(F.xxhash64("node", F.lit(j)), F.lit(spec.pool))).cast("int") for j in range(spec.branches)]
        chosen = [F.xxhash64("node", F.lit(level), F.lit(j), F.get("tokens", pick)) for j, pick in enumerate(picks)]
        below = large.join(classes.select("class", "tokens"), "class").select(F.explode(F.array(*chosen)).alias("node"), "tree", "class")
        now = _shared(below, rows)
    for part in done:
        now = now.unionByName(part)
    return now


def _shared(rows: DataFrame, most: int | None) -> DataFrame:
    counts = rows.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return materialise(rows.join(counts, "node"), "nodes", most)


def _agree(spec: JoinSpec, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether rows of sketches a and b, of sets of so many shingles, may be linked."""
    near = (a == b).sum(axis=-1) >= spec.least_agreement
    return near & (spec.denominator * np.minimum(na, nb) >= spec.numerator * np.maximum(na, nb))


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SKETCH)


def pivot_pairs(found: DataFrame, classes: DataFrame, spec: JoinSpec) -> DataFrame:
    """Pairs (a, b) of a class and a pivot of one of its leaves that the sketches can't rule out."""
    own = found.select("node", "class").join(classes.select("class", "sketch", "n_shingles"), "class")
    mark = F.struct("class", "sketch", "n_shingles")
    pivots = own.groupBy("node").agg(F.min_by(mark, F.xxhash64("class")).alias("p"), F.min_by(mark, F.xxhash64("class", F.lit(1))).alias("q"))
    both = own.join(pivots, "node").select(F.explode(F.array("p", "q")).alias("p"), "class", "sketch", "n_shingles")
    both = both.select("class", "sketch", "n_shingles", F.col("p.class").alias("pivot"), F.col("p.sketch").alias("pivot_sketch"), F.col("p.n_shingles").alias("pivot_n")).where(F.col("class") != F.col("pivot"))

    def near(batches):
        for batch in batches:
            keep = _agree(spec, _sketches(batch["sketch"]), _sketches(batch["pivot_sketch"]), batch["n_shingles"].to_numpy(), batch["pivot_n"].to_numpy())
            yield pa.RecordBatch.from_arrays([batch["pivot"], batch["class"]], names=["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(lean(near), "a binary, b binary").distinct()


def spanning(near: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges between places that connect whatever near (first x second) connects, at most one a place."""
    none = len(first)
    rows, columns = np.arange(none), np.full(len(second), none)
    while near.any():
        columns = np.where(near, rows[:, None], none).min(axis=0)
        # A place that is in both sides carries its label across.
        at = np.searchsorted(first, second)
        shared = (at < none) & (first[np.minimum(at, none - 1)] == second)
        columns[shared] = np.where(columns[shared] < none, np.minimum(columns[shared], rows[at[shared]]), columns[shared])
        now = np.minimum(rows, np.where(near, columns[None, :], none).min(axis=1))
        now[at[shared]] = np.minimum(now[at[shared]], columns[shared])
        now = np.minimum(now, now[now])
        if (now == rows).all():
            break
        rows = now
    left, right = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    a, b = np.concatenate([first[left], second[right]]), np.concatenate([first[rows[left]], first[columns[right]]])
    return a[a != b], b[a != b]


def _sides(rows: pa.Table, key: tuple) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Classes, roots as small numbers, and the places of the rows of either block."""
    names, roots, side = rows["class"].to_pylist(), rows["root"].to_pylist(), rows["block"].to_numpy()
    code = {r: k for k, r in enumerate(dict.fromkeys(roots))}
    return names, np.array([code[r] for r in roots]), np.flatnonzero(side == key[1]), np.flatnonzero(side == key[2])


def _edges(names: list, near: np.ndarray, first: np.ndarray, second: np.ndarray) -> Iterator[pa.RecordBatch]:
    a, b = spanning(near, first, second)
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in a.tolist()], pa.binary()), pa.array([names[x] for x in b.tolist()], pa.binary())], names=["a", "b"])


def families(found: DataFrame, classes: DataFrame, roots: DataFrame, spec: JoinSpec) -> DataFrame:
    """(class, root, family) of every class that shares a leaf with one of another component that the sketches can't rule out.

    A leaf gives no pairs but edges that connect them, at most one a member; any two
    members that might be linked are then in one family.
    """
    own = found.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    mixed = own.groupBy("node").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")).where(F.col("low") != F.col("high")).select("node", "size")
    own = own.select("node", "class", "root").join(mixed, "node").join(classes.select("class", "sketch", "n_shingles"), "class")

    def run(batches):
        for key, rows in sorted_groups(batches, ["node", "i", "j"]):
            names, root, first, second = _sides(rows, key)
            sketch, n = _sketches(rows["sketch"].combine_chunks()), rows["n_shingles"].to_numpy()
            near = np.zeros((len(first), len(second)), bool)
            for k, x in enumerate(first):
                apart = np.flatnonzero(root[second] != root[x])
                if len(apart):
                    near[k, apart] = _agree(spec, sketch[second[apart]], sketch[x], n[second[apart]], n[x])
            yield from _edges(names, near, first, second)

    edges = in_blocks(own, "node", spec.sketch_block).mapInArrow(lean(run), "a binary, b binary")
    named = connected_components(edges).select(F.col("node").alias("class"), F.col("root").alias("family"))
    return named.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").select("class", F.coalesce("root", "class").alias("root"), "family")


def linked_edges(sets: list[np.ndarray], sketch: np.ndarray, root: np.ndarray, first: np.ndarray, second: np.ndarray, spec: JoinSpec) -> list[tuple[int, int]]:
    """Links between first and second that join different roots, until none is left; pairs that earlier links have joined aren't compared.

    A pair that the sketches can't rule out is counted exactly: the tokens of one set
    are marked in a table of all tokens, and the marks of the others' tokens summed.
    """
    n = np.array([len(s) for s in sets])
    label, found = root.copy(), []
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    codes = np.split(code, np.cumsum(n)[:-1])
    marks = np.zeros(code.max(initial=0) + 1, np.int64)
    for x in first:
        others = second[label[second] != label[x]]
        if not len(others):
            continue
        others = others[_agree(spec, sketch[others], sketch[x], n[others], n[x])]
        if not len(others):
            continue
        marks[codes[x]] = 1
        shared = np.add.reduceat(marks[np.concatenate([codes[y] for y in others])], np.cumsum(n[others]) - n[others])
        marks[codes[x]] = 0
        for y in others[spec.denominator * shared >= spec.numerator * (n[x] + n[others] - shared)]:
            if label[x] != label[y]:
                found.append((int(x), int(y)))
                label[label == label[y]] = label[x]
    return found


def confirm_families(rows: DataFrame, classes: DataFrame, texts: DataFrame, spec: JoinSpec) -> DataFrame:
    """Links that connect the different components of each family as all its links do; every pair is compared, on the full sets."""
    sizes = rows.groupBy("family").agg(F.count("*").alias("size"))
    rows = rows.join(sizes, "family").join(classes.select("class", "sketch"), "class").join(texts, "class")
    rows = in_blocks(rows, "family", spec.block)

    def run(batches):
        for key, group in sorted_groups(batches, ["family", "i", "j"]):
            names, root, first, second = _sides(group, key)
            sets = [s for chunk in group["text"].chunks for s in sets_of(chunk, spec.words)]
            sound = np.array([fingerprint(s) == name for s, name in zip(sets, names)])  # else another text of a repeated doc_id
            edges = linked_edges(sets, _sketches(group["sketch"].combine_chunks()), root, first[sound[first]], second[sound[second]], spec)
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([names[e[k]] for e in edges], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return rows.select("family", "i", "j", "block", "class", "root", "sketch", "text").mapInArrow(lean(run), "a binary, b binary")


def confirm(pairs: DataFrame, texts: DataFrame, spec: JoinSpec) -> DataFrame:
    """Of pairs(a, b) those whose full sets are similar enough. texts has class and text.

    The sets that are compared with a come after it in one sorted run, `chunk` of
    them a run, so a task holds one set and a batch of texts however many pairs a has.
    """
    runs = pairs.groupBy("a").agg(F.count("*").alias("n")).select("a", F.ceil(F.col("n") / spec.chunk).cast("int").alias("runs"))
    dealt = pairs.join(runs, "a").withColumn("run", F.pmod(F.xxhash64("b"), F.col("runs")).cast("int")).select("a", "run", "b")
    heads = dealt.select("a", "run").distinct().select("a", "run", F.lit(None).cast("binary").alias("b"), F.col("a").alias("class"))
    rows = heads.unionByName(dealt.withColumn("class", F.col("b"))).join(texts, "class").select("a", "run", "b", "text")

    def compare(batches):
        key, whole = None, None
        for batch in batches:
            a_out, b_out = [], []
            for a, run, b, found in zip(batch["a"].to_pylist(), batch["run"].to_pylist(), batch["b"].to_pylist(), sets_of(batch["text"], spec.words)):
                if b is None:
                    if fingerprint(found) == a:  # else another text of a repeated doc_id
                        key, whole = (a, run), found
                elif key == (a, run) and fingerprint(found) == b:
                    shared = len(np.intersect1d(whole, found, assume_unique=True))
                    if spec.linked(shared, len(whole), len(found)):
                        a_out.append(a)
                        b_out.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.binary()), pa.array(b_out, pa.binary())], names=["a", "b"])

    return rows.repartition("a", "run").sortWithinPartitions("a", "run", F.col("b").asc_nulls_first()).mapInArrow(lean(compare), "a binary, b binary").distinct()


def _texts(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(class, text), one text of every wanted(class, id)."""
    found = sieve(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), wanted.select("id"), "id", ["text"])
    return found.join(wanted, "id").select("class", "text")


def near_duplicates(docs: DataFrame, spec: JoinSpec = JoinSpec()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs(doc_id, text)."""
    signed = materialise(signatures(docs, spec), "signatures")
    known = signed.where(F.col("class").isNotNull() & F.col("doc_id").isNotNull())
    mark = F.struct("sketch", "tokens")
    classes = known.groupBy("class").agg(F.min("doc_id").alias("first"), F.first("n_shingles").alias("n_shingles"), F.first(mark).alias("m")).select("class", "first", "n_shingles", "m.sketch", "m.tokens")
    most = signed.count()
    classes = materialise(classes, "classes", most)
    found = leaves(classes, spec, most)
    pairs = materialise(pivot_pairs(found, classes, spec), "pairs", 2 * most)
    first = classes.select("class", F.col("first").alias("id"))
    wanted = materialise(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(first, "class"), "wanted", most)
    links = materialise(confirm(pairs, _texts(wanted, docs), spec), "links", 2 * most)
    roots = connected_components(links, links.count())
    discard(pairs, wanted, links)
    rest = materialise(families(found, classes, roots, spec), "families", most)
    wanted = materialise(rest.select("class").distinct().join(first, "class"), "wanted", most)
    more = confirm_families(rest, classes, _texts(wanted, docs), spec)
    same_id = known.select("doc_id", "class").distinct().groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("b")).where(F.col("a") != F.col("b"))
    chain = known.join(same_id.select("doc_id", "a"), "doc_id").select("a", F.col("class").alias("b"))
    roots = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more).unionByName(chain), 4 * most)
    discard(rest, wanted)
    named = roots.join(classes.select(F.col("class").alias("node"), "first"), "node").select("node", "root", "first")
    named = named.join(named.groupBy("root").agg(F.min("first").alias("component")), "root").select(F.col("node").alias("class"), "component")
    named = materialise(classes.select("class", "first").join(named, "class", "left").select("class", F.coalesce("component", "first").alias("component")), "components", most)
    rows = signed.select("doc_id", "n_shingles", "class").join(named, "class", "left")
    discard(classes)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents: its component of near copies."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


_SETS = r"""
texts AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM texts),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
pairs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM sets UNION SELECT pairs.b, reach.root FROM reach JOIN pairs ON pairs.a = reach.doc_id),
named AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)"""
ORACLE = {
    "op5_minhash_near_dedup": f"""
WITH RECURSIVE {_SETS}
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN named USING (doc_id)""",
}
