"""Connected components of an edge table by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def connected_components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, root) of every node of edges(a, b) that has a neighbour other than itself; root is its component's least node. most: a bound of the edges, if known.

    Nodes are of any ordered type. Rows with a null, loops and repeated edges
    count for nothing. Each round keeps at most as many edges as the round before,
    and is written to the shared checkpoint folder; minima are counted before
    they are shuffled and joins by a hub can be split, so a hub costs no single
    task its edges.
    """
    now = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    now = now.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, state = materialise(now, "edges", most), None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 31)), F.sum(F.xxhash64("v", "u") % (1 << 31))).first()
        if seen == state or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("k")).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(least, F.col("u") == F.col("k")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        before, now = now, materialise(small.where(F.col("u") != F.col("v")).distinct(), "edges", seen[0])
        discard(before)
