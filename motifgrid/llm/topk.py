"""Exact top-k inner products by norm order, rotated partial sums and Cauchy-Schwarz bounds.

Vectors become whole numbers, floor(scale * x). The second-moment matrix of all of
them (dimension squared numbers, summed over partitions) gives a rotation whose
first axes hold most of every inner product. Candidates are sorted into bands of
length. First all queries meet the longest band, whose k-th score bounds each query
from below; then a query goes on only to the bands whose greatest length times its own
can reach that score, and a band only to the blocks of queries that still ask for it,
so by Cauchy-Schwarz what can't matter is left out before the shuffle. Where a block of
queries meets a part of a band, blocks of descending length are passed over by the same
bound; of the others the partial sum over the first axes plus the product of the
residual lengths bounds the score, and only what that bound leaves is scored exactly,
in whole numbers. The lists of at most k are merged by query.

Queries are dealt in blocks and bands in parts, by id, so a task holds one block of
queries and one part of candidates, however many there are and however many of one
length. The driver holds two numbers a band.

Defined results: vectors that are null, empty or hold a null or non-finite
component take no part. Vectors meet those with as many components; the axes are
rotated for the most common number, others keep their own axes. A row with a null id takes no part. Scores are exact up to 2**53. Rows with the query's own id
are not its candidates; other repeated rows are candidates each; of several vectors
with a query's id the least, component by component, asks. Ties go to the smaller id. With fewer
than k candidates all are returned; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import materialise, table


@dataclass(frozen=True)
class TopK:
    k: int = 20
    scale: int = 64
    queries_a_block: int = 2048
    candidates_a_group: int = 16_384
    candidates_a_block: int = 1024
    #: Bands of length at most; one of more than a group's candidates comes in parts.
    bands: int = 256
    #: Share of the axes whose partial sums are taken first.
    head: float = 0.25


def whole_vectors(vectors: DataFrame, spec: TopK = TopK()) -> DataFrame:
    """(vec_id, v) with whole components, for vectors(vec_id, embedding)."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(sound & F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long"), F.transform(x, lambda c: F.floor(c * spec.scale).cast("long")).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def rotation(rows: DataFrame) -> np.ndarray | None:
    """Axes of the second moments, most important first; null if there are no rows."""

    def sums(batches):
        total = None
        for batch in batches:
            x = _matrix(batch["v"]).astype(np.float64)
            total = x.T @ x if total is None else total + x.T @ x
        if total is not None and total.size:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["m"])

    parts = rows.select("v").mapInArrow(sums, "m array<double>").select(F.posexplode("m").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").toArrow()
    if not parts.num_rows:
        return None
    d = int(round(parts.num_rows**0.5))
    return np.linalg.eigh(parts["x"].to_numpy().reshape(d, d))[1][:, ::-1]


def search_block(queries: tuple[np.ndarray, np.ndarray], candidates: tuple[np.ndarray, np.ndarray], axes: np.ndarray, spec: TopK, least: np.ndarray | float = -np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, id, score) of the best k of the candidates for each query; both are (ids, whole vectors). least: scores below it aren't asked for."""
    ids, x = queries
    other, y = candidates
    length = np.sqrt((y.astype(np.float64) ** 2).sum(axis=1))
    order = np.lexsort((other, -length))
    other, y, length = other[order], y[order], length[order]
    head = max(1, int(round(spec.head * y.shape[1])))
    xr, yr = x.astype(np.float64) @ axes, y.astype(np.float64) @ axes
    x_rest, y_rest = np.sqrt((xr[:, head:] ** 2).sum(axis=1)), np.sqrt((yr[:, head:] ** 2).sum(axis=1))
    x_length = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    exact = np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * y.shape[1] < 2**53
    xf, yf = (x.astype(np.float64), y.astype(np.float64)) if exact else (x, y)
    best = np.full((len(ids), spec.k), -np.inf)
    named = np.full((len(ids), spec.k), np.iinfo(np.int64).max)
    for a in range(0, len(other), spec.candidates_a_block):
        b = min(a + spec.candidates_a_block, len(other))
        floor = np.maximum(best[:, -1], least)
        slack = 1e-9 * (x_length * length[a] + 1)
        alive = np.flatnonzero(x_length * length[a] + slack >= floor)
        if not len(alive):
            break
        bound = xr[alive, :head] @ yr[a:b, :head].T + x_rest[alive, None] * y_rest[a:b] + slack[alive, None]
        live = bound >= floor[alive, None]
        rows, columns = np.flatnonzero(live.any(axis=1)), np.flatnonzero(live.any(axis=0))
        if not len(rows):
            continue
        alive = alive[rows]
        score = np.where(live[np.ix_(rows, columns)] & (ids[alive, None] != other[a:b][columns]), xf[alive] @ yf[a:b][columns].T, -np.inf)
        scores = np.concatenate([best[alive], score], axis=1)
        names = np.concatenate([named[alive], np.broadcast_to(other[a:b][columns], score.shape)], axis=1)
        if scores.shape[1] > 4 * spec.k:  # ties at the k-th score all stay until ids decide
            kth = -np.partition(-scores, spec.k - 1, axis=1)[:, spec.k - 1]
            width = int((scores >= kth[:, None]).sum(axis=1).max())
            if width < scores.shape[1]:
                top = np.argpartition(-scores, width - 1, axis=1)[:, :width]
                scores, names = np.take_along_axis(scores, top, 1), np.take_along_axis(names, top, 1)
        keep = np.lexsort((names, -scores), axis=1)[:, : spec.k]
        best[alive], named[alive] = np.take_along_axis(scores, keep, 1), np.take_along_axis(names, keep, 1)
    place, rank = np.nonzero(best > -np.inf)
    return place, named[place, rank], best[place, rank].astype(np.int64)


@dataclass(frozen=True)
class Bands:
    """Bands of candidates by length, the longest first: least lengths of all but the last, greatest lengths, parts."""

    edges: list[float]
    greatest: list[float]
    parts: list[int]

    @classmethod
    def of(cls, rows: DataFrame, spec: TopK) -> "Bands":
        """Of rows(length), some; bands without rows are left out."""
        n = min(spec.bands, -(-rows.count() // spec.candidates_a_group))
        found = rows.agg(F.percentile_approx("length", [1 - i / n for i in range(1, n)], 40 * n)).first()[0] if n > 1 else []
        edges = sorted(set(found), reverse=True)
        held = rows.groupBy(_band(edges).alias("band")).agg(F.count("*").alias("n"), F.max("length").alias("most")).orderBy("band").collect()
        return cls([edges[r["band"]] for r in held[:-1]], [r["most"] for r in held], [-(-r["n"] // spec.candidates_a_group) for r in held])

    def band(self) -> Column:
        return _band(self.edges)

    def part(self) -> Column:
        return F.pmod(F.xxhash64("vec_id"), F.get(_numbers(self.parts), F.col("band"))).cast("int")

    def every_part(self) -> Column:
        return F.explode(F.sequence(F.lit(0), F.get(_numbers(self.parts), F.col("band")) - 1)).alias("part")

    def reach(self) -> Column:
        """How many bands, from the longest, may hold a score of `least` or more for a query of this length."""
        may = F.size(F.filter(_numbers(self.greatest), lambda m: m * F.col("length") * (1 + 1e-9) + 1e-6 >= F.col("least")))
        return F.when(F.col("least").isNull(), len(self.greatest)).otherwise(may)


def _numbers(values: list) -> Column:
    return F.array(*(F.lit(x) for x in values))


def _band(edges: list[float]) -> Column:
    return F.size(F.filter(_numbers(edges), lambda e: e > F.col("length"))) if edges else F.lit(0)


_ASKED = ("d", "block", "band", "part", "vec_id", "v", "least")


def first_round(queries: DataFrame, rows: DataFrame, bands: Bands, n_queries: int, spec: TopK) -> tuple[DataFrame, DataFrame]:
    """Queries and candidates as they meet in the longest band."""
    blocks = max(1, -(-n_queries // spec.queries_a_block))
    asked = queries.withColumns({"block": F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"), "band": F.lit(0), "least": F.lit(None).cast("double")}).select("*", bands.every_part())
    offered = rows.where(F.col("band") == 0).select("*", bands.part().alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).withColumn("least", F.lit(None).cast("double"))
    return asked.select(*_ASKED), offered.select(*_ASKED)


def second_round(queries: DataFrame, rows: DataFrame, bands: Bands, best: DataFrame, spec: TopK) -> tuple[DataFrame, DataFrame]:
    """Queries and candidates as they meet in all other bands, after the longest gave best(query_id, score).

    Queries are dealt by how many bands they reach, those that reach most first, so
    a band is asked for by the first blocks and no others.
    """
    least = best.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= spec.k).select("vec_id", F.col("least").cast("double"))
    asked = queries.join(least, "vec_id", "left").withColumn("reach", bands.reach()).where(F.col("reach") > 1)
    counts = {r["reach"]: r["count"] for r in asked.groupBy("reach").count().collect()}
    size, n = [counts.get(r, 0) for r in range(len(bands.greatest) + 1)], len(bands.greatest)
    before = [sum(size[r + 1 :]) for r in range(n + 1)]  # queries that reach further
    blocks = [-(-before[j] // spec.queries_a_block) for j in range(n)]  # of those that reach band j
    place = F.get(_numbers(before), F.col("reach")) + F.pmod(F.xxhash64("vec_id"), F.get(_numbers(size), F.col("reach")))
    asked = asked.withColumn("block", F.floor(place / spec.queries_a_block).cast("int")).select("*", F.explode(F.sequence(F.lit(1), F.col("reach") - 1)).alias("band")).select("*", bands.every_part())
    offered = rows.where(F.col("band") > 0).withColumn("blocks", F.get(_numbers(blocks), F.col("band"))).where(F.col("blocks") > 0)
    offered = offered.select("*", bands.part().alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).withColumn("least", F.lit(None).cast("double"))
    return asked.select(*_ASKED), offered.select(*_ASKED)


def top_k(vectors: DataFrame, is_query: Column, spec: TopK = TopK()) -> DataFrame:
    """query_id, rank, vec_id and score of the k greatest inner products of each query with all other rows of vectors(vec_id, embedding)."""
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda total, c: total + c.cast("double") * c.cast("double")))
    rows = materialise(whole_vectors(vectors, spec).withColumn("length", length), "vectors").withColumn("d", F.size("v"))
    common = rows.groupBy("d").count().orderBy(F.desc("count"), "d").limit(1).collect()
    axes = rotation(rows.where(F.col("d") == common[0]["d"])) if common else None
    kept = "query_id long, rank int, vec_id long, score long"
    if axes is None:
        return rows.sparkSession.createDataFrame([], kept)
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "length", "d")).alias("q")).select("vec_id", "q.v", "q.length", "q.d")
    bands = Bands.of(rows, spec)
    rows = rows.withColumn("band", bands.band())

    def search(key: tuple[pa.Scalar, ...], found: pa.Table) -> pa.Table:
        found = found.combine_chunks()
        x, y = found.filter(found["asks"]), found.filter(pc.invert(found["asks"]))
        ids = x["vec_id"].to_numpy()
        place, name, score = np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if x.num_rows and y.num_rows:
            own = axes if key[0].as_py() == len(axes) else np.eye(key[0].as_py())
            least = x["least"].fill_null(-np.inf).to_numpy()
            place, name, score = search_block((ids, _matrix(x["v"].combine_chunks())), (y["vec_id"].to_numpy(), _matrix(y["v"].combine_chunks())), own, spec, least)
        return pa.table({"query_id": ids[place], "vec_id": name, "score": score})

    def best_of(lists: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= spec.k).select("query_id", "rank", "vec_id", "score")

    def met(asked: DataFrame, offered: DataFrame) -> DataFrame:
        both = asked.withColumn("asks", F.lit(True)).unionByName(offered.withColumn("asks", F.lit(False)))
        return both.groupBy("d", "block", "band", "part").applyInArrow(search, "query_id long, vec_id long, score long")

    best = best_of(met(*first_round(queries, rows, bands, queries.count(), spec)))
    if len(bands.greatest) == 1:
        return best
    best = materialise(best.drop("rank"), "best")
    return best_of(best.unionByName(met(*second_round(queries, rows, bands, best, spec))))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 greatest inner products of every vector whose id is divisible by 20."""
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


ORACLE = {
    "op4_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
}
