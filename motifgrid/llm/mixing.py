"""Mixing sources to target weights by Pfair scheduling.

Rows of a source, in an order drawn by hash, form blocks. Block j of a source of
weight w (a share of all weights, an exact fraction) is released at floor(j / w) and due
at ceil((j + 1) / w); in each slot the released block with the earliest deadline goes
next. As long as no source has run out, after any number of slots each source has had
its target share to within less than one block; later slots of a source that ran out
are passed over, so the rest keep their proportions. Every row is placed once.

The schedule is made on the driver, block by block, from the sources' row counts alone.
Its length is bounded: a block has `block` rows, or as many more as keep the table
within `max_blocks` blocks, so deviations are under a millionth of a large mix.

Ranks are prefix sums on two levels: groups of about `group` rows are numbered by
windows, their totals by a window over groups, so no window holds a source. Rows of one
source with equal ids stand in one group.

Defined results: a null source is a source of its own. Ties and repeated rows keep
places of their own (equal ids in any order). An empty table gives an empty one.
Sources without a weight are an error, as is a weight that isn't positive and finite;
weights of absent sources count for nothing. More than `max_sources` sources are an
error: their weights and counts are held by the driver. Other columns, whatever their
names, are kept by mix() and left out by the query; place() keeps them too, but those
that it adds mustn't be there already.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import table


@dataclass(frozen=True)
class MixSpec:
    """block: rows, at least. temperature: without weights a source weighs rows ** temperature."""

    block: int = 16
    max_blocks: int = 1 << 20
    temperature: float = 0.5
    group: int = 8_192
    max_sources: int = 100_000
    seed: int = 1

    def rows_a_block(self, rows: int) -> int:
        return max(self.block, -(-rows // self.max_blocks))


def shares(weights: dict) -> dict:
    """Each weight as an exact share of all."""
    if any(not (math.isfinite(w) and w > 0) for w in weights.values()):
        raise ValueError("weights must be positive and finite")
    total = sum(map(Fraction, weights.values()))
    return {k: Fraction(w) / total for k, w in weights.items()}


def schedule(weights: dict, blocks: dict) -> dict:
    """The slot of each of a source's blocks: earliest deadline first among released blocks, slots without one passed over."""
    names = sorted(blocks, key=lambda k: (k is None, str(k)))
    share = shares(weights)
    up, down = [share[k].denominator for k in names], [share[k].numerator for k in names]
    count = [blocks[k] for k in names]
    waiting = [(0, -(-up[i] // down[i]), i, 0) for i in range(len(names)) if count[i]]  # release, deadline, source, block
    heapq.heapify(waiting)
    ready: list = []
    slots = {k: [] for k in names}
    now = 0
    while waiting or ready:
        if not ready:
            now = max(now, waiting[0][0])
        while waiting and waiting[0][0] <= now:
            _, due, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due, i, j))
        _, i, j = heapq.heappop(ready)
        slots[names[i]].append(now)
        now += 1
        if (j := j + 1) < count[i]:
            heapq.heappush(waiting, (j * up[i] // down[i], -(-(j + 1) * up[i] // down[i]), i, j))
    return slots


def _running(rows: DataFrame, by: list[str], unit: str, size: str) -> DataFrame:
    """rows(by..., unit, size) with `before`: the sum of size over smaller units; units are grouped by thousands first."""
    coarse = F.floor(F.col(unit) / 1024)
    total = rows.groupBy(*by, coarse.alias("coarse")).agg(F.sum(size).alias("whole"))
    total = total.withColumn("below", F.coalesce(F.sum("whole").over(Window.partitionBy(*by).orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("whole")
    within = Window.partitionBy(*by, "coarse").orderBy(unit).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("coarse", coarse).join(total, [*by, "coarse"]).withColumn("before", F.col("below") + F.coalesce(F.sum(size).over(within), F.lit(0))).drop("coarse", "below")


ADDED = ("mix_rank", "mix_block", "mix_slot", "mix_position")


def place(rows: DataFrame, weights: dict | None = None, spec: MixSpec = MixSpec(), key: str = "doc_id", source: str = "source") -> DataFrame:
    """rows with mix_rank (in its source), mix_block, mix_slot and mix_position, gapless from 0 in the order of the mix."""
    if taken := [c for c in rows.columns if c in ADDED]:
        raise ValueError(f"rows already have {taken}")
    placed = _placed(rows, weights, spec, key, source)
    return placed.select(*(F.col("row")[c].alias(c) for c in rows.columns), *(F.col(c[4:]).alias(c) for c in ADDED))


def _placed(rows: DataFrame, weights: dict | None, spec: MixSpec, key: str, source: str) -> DataFrame:
    """(row, rank, block, slot, position) for each row."""
    counted = rows.groupBy(F.col(source).cast("string").alias("name")).agg(F.count("*").alias("n")).limit(spec.max_sources + 1).collect()
    if len(counted) > spec.max_sources:
        raise ValueError(f"more than {spec.max_sources} sources")
    counts = {r["name"]: r["n"] for r in counted}
    if weights is None:
        weights = {k: n**spec.temperature for k, n in counts.items()}
    if missing := [k for k in counts if k not in weights]:
        raise ValueError(f"no weight for {missing[:5]}")
    size = spec.rows_a_block(sum(counts.values()))
    slots = schedule({k: weights[k] for k in counts}, {k: -(-n // size) for k, n in counts.items()})
    starts = {k: [0] * len(own) for k, own in slots.items()}
    at = 0
    for _, k, j in sorted(((t, k, j) for k, own in slots.items() for j, t in enumerate(own)), key=lambda x: x[0]):
        starts[k][j] = at
        at += min(size, counts[k] - j * size)
    spark = rows.sparkSession
    # A row a source, at most max_sources; and two numbers a block, at most max_blocks and one more a source.
    known = spark.createDataFrame([(i, k, max(1, -(-counts[k] // spec.group))) for i, k in enumerate(counts)], "no int, name string, groups long")
    planned = spark.createDataFrame([(i, slots[k], starts[k]) for i, k in enumerate(counts)], "plan_no int, slots array<long>, starts array<long>")
    own = rows.select(F.struct("*").alias("row"), F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.xxhash64(F.col(key), F.lit(spec.seed)).alias("hash"))
    own = own.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("name"))).withColumn("group", F.pmod("hash", "groups")).select("row", "key", "hash", "no", "group")
    sizes = own.groupBy("no", "group").agg(F.count("*").alias("n"))
    before = _running(sizes, ["no"], "group", "n").select("no", "group", "before")
    order = Window.partitionBy("no", "group").orderBy("hash", "key")
    own = own.withColumn("in", F.row_number().over(order) - 1).join(before, ["no", "group"])
    ranked = own.select("row", "no", (F.col("before") + F.col("in")).alias("rank"))
    ranked = ranked.withColumn("block", F.floor(F.col("rank") / size)).join(F.broadcast(planned), F.col("no") == F.col("plan_no"))
    where = F.get("starts", F.col("block").cast("int")) + F.pmod("rank", F.lit(size))
    return ranked.select("row", F.col("rank").cast("long").alias("rank"), F.col("block").cast("long").alias("block"), F.get("slots", F.col("block").cast("int")).alias("slot"), where.cast("long").alias("position"))


def mix(rows: DataFrame, weights: dict | None = None, spec: MixSpec = MixSpec(), key: str = "doc_id", source: str = "source") -> DataFrame:
    """rows with the same columns in the order of the mix, by partition and within each."""
    placed = _placed(rows, weights, spec, key, source).select("row", "position")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionByRange(n, "position").sortWithinPartitions("position").select(*(F.col("row")[c].alias(c) for c in rows.columns))


def op3_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in a mix of the sources."""
    placed = place(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return placed.select("doc_id", "source", "mix_rank", "mix_block", "mix_slot", "mix_position")
