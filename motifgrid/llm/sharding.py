"""Sharding by balanced label propagation.

Documents that share a group (the query: equal texts) are linked. Each starts in the
shard of its hash; what counts afterwards are the classes of a group's documents in
one shard, of which a group has at most as many as there are shards, however many
documents it holds. In every round a class moves to the shard that holds more of its
group (ties by the round's hash, so that no two classes swap), as far as that shard's quota and
the rows that leave it in the same round allow; movers are admitted in the order of
their hashes, in buckets. By turns a full shard is passed over for the next best, and in every third
round the hash alone orders a group's shards. Moves never add a cut. The rounds end when no group is cut, or after `patience` rounds without a cut less. At
last unlinked documents fill the shards: each shard ranks its documents, linked ones
first, and what lies beyond its exact share goes to shards with room. So shards differ
by at most one row. Cut are groups larger than a quota, those that no exchange has
brought together, and those at the ends of shares if linked rows exceed them.

Everything is DataFrame expressions. State is kept by class; the loads that come to
the driver are one number a shard, and those of movers one a bucket of two shards.

Defined results: a null text has no bytes, checksum 0 and no links; empty texts are
equal texts. Rows with a null or repeated id are rows like others, each with a slot.
An empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import discard, materialise, table


@dataclass(frozen=True)
class ShardSpec:
    shards: int = 16
    #: Rounds without a cut less, after which propagation ends.
    patience: int = 6
    #: Buckets of movers between two shards that are admitted or not as one.
    buckets: int = 64
    #: Rows that a ranking window holds, about.
    window: int = 8192


def _pick(numbers: list[int], at: Column) -> Column:
    return F.get(F.array(*(F.lit(n).cast("long") for n in numbers)), at.cast("int"))


def _admit(wanted: list[tuple[int, int, int, int]], room: list[int], spec: ShardSpec) -> list[int]:
    """For each pair of shards (from * shards + to) the bucket before which movers are admitted.

    wanted: (from, to, bucket, rows). A shard may take its room and as many rows as
    leave it in the same round, so full shards exchange rows.
    """
    own: dict = {}
    for a, b, bucket, n in sorted(wanted):
        own.setdefault((a, b), []).append((bucket, n))
    gain = [0] * spec.shards
    for (a, b), moves in own.items():
        n = sum(x for _, x in moves)
        gain[a], gain[b] = gain[a] - n, gain[b] + n
    limit = [spec.buckets] * spec.shards**2
    over = [s for s in range(spec.shards) if gain[s] > max(0, room[s])]
    while over:
        s = max(over, key=lambda x: gain[x] - max(0, room[x]))
        while gain[s] > max(0, room[s]):
            a = max((x for x in range(spec.shards) if own.get((x, s))), key=lambda x: own[x, s][-1])  # the last bucket of all that come
            bucket, n = own[a, s].pop()
            limit[a * spec.shards + s] = bucket
            gain[a], gain[s] = gain[a] + n, gain[s] - n
        over = [x for x in range(spec.shards) if gain[x] > max(0, room[x])]
    return limit


def _round(classes: DataFrame, room: list[int], most: list[int], spec: ShardSpec, number: int) -> DataFrame:
    """One round of moves: classes(group, start, shard, n, all) with new shards; most: rows of a class that may ask for each shard."""
    here = classes.groupBy("group", "shard").agg(F.sum("n").alias("held"))
    # In every third round the hash alone decides, so that a shard that none leaves can give rows instead.
    first = F.when(F.lit(number % 3 == 2), F.lit(0)).otherwise(F.col("held")).alias("first")
    held = here.groupBy("group").agg(F.collect_list(F.struct(first, F.xxhash64("group", "shard", F.lit(number)).alias("tie"), "shard")).alias("places"))  # one entry a shard at most
    rows = classes.join(held, "group")
    own = F.element_at(F.filter("places", lambda p: p["shard"] == F.col("shard")), 1)
    better = F.filter("places", lambda p: (F.struct(p["first"], p["tie"]) > F.struct(own["first"], own["tie"])) & (_pick(most, p["shard"]) >= F.col("n")))
    rows = rows.withColumn("goal", F.array_max(better)["shard"]).withColumn("bucket", F.pmod(F.xxhash64("group", "start", F.lit(number)), F.lit(spec.buckets)))
    rows = materialise(rows.select("group", "start", "shard", "n", "all", "goal", "bucket"), "goals", classes.count())
    wanted = rows.where(F.col("goal").isNotNull()).groupBy("shard", "goal", "bucket").agg(F.sum("n").alias("n")).collect()  # at most shards * shards * buckets rows
    limit = _admit([tuple(r) for r in wanted], room, spec)
    goes = F.col("goal").isNotNull() & (F.col("bucket") < _pick(limit, F.col("shard") * spec.shards + F.col("goal")))
    moved = materialise(rows.select("group", "start", F.when(goes, F.col("goal")).otherwise(F.col("shard")).alias("shard"), "n", "all"), "classes", classes.count())
    discard(rows)
    return moved


def propagate(rows: DataFrame, spec: ShardSpec = ShardSpec()) -> DataFrame:
    """(group, start, shard, all): where the linked rows of a group of `all` rows go from the shard they start in, for rows(group, start)."""
    most = rows.count()
    counted = rows.where(F.col("group").isNotNull()).groupBy("group", "start").agg(F.count("*").alias("n"))
    linked = counted.groupBy("group").agg(F.sum("n").alias("all")).where(F.col("all") > 1).select("group", "all")
    classes = materialise(counted.join(linked, "group").select("group", "start", F.col("start").alias("shard"), "n", "all"), "classes", most)
    quota = -(-most // spec.shards)
    least, idle, number = classes.select("group", "shard").distinct().count(), 0, 0
    groups = classes.select("group").distinct().count()
    while least > groups and idle < spec.patience:
        load = {r["shard"]: r["n"] for r in classes.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        room = [quota - load.get(s, 0) for s in range(spec.shards)]
        # By turns: the best shard, in exchange for what leaves it, and the best one with room.
        moved = _round(classes, room, room if number % 2 else [quota] * spec.shards, spec, number)
        discard(classes)
        classes, number = moved, number + 1
        places = classes.select("group", "shard").distinct().count()
        least, idle = min(least, places), 0 if places < least else idle + 1
    return classes.select("group", "start", "shard", "all")


def balanced_shards(rows: DataFrame, spec: ShardSpec = ShardSpec()) -> DataFrame:
    """rows(id, group, ...) with shard and slot; group is null for rows without links."""
    start = F.pmod(F.xxhash64("id", "group"), F.lit(spec.shards)).cast("int")
    # Written with the rows, so that it stays: rows without an id are told apart by where they were read.
    salt = F.coalesce(F.when(F.col("id").isNotNull(), F.xxhash64("id", F.lit(1))), F.xxhash64(F.monotonically_increasing_id()))
    rows = materialise(rows.withColumn("start", start).withColumn("salt", salt), "rows")
    classes = propagate(rows, spec)
    goes = classes.select(F.col("group").alias("g"), F.col("start").alias("s"), "shard", "all", F.lit(1).alias("linked"))
    rows = rows.join(goes, (F.col("group") == F.col("g")) & (F.col("start") == F.col("s")), "left").drop("g", "s")
    rows = rows.withColumn("shard", F.coalesce("shard", "start")).withColumn("linked", F.coalesce("linked", F.lit(0)))
    n = rows.count()
    parts = max(1, n // spec.shards // spec.window)
    # Linked rows first, a group's rows together, but those of a hot group dealt to as many windows as they fill.
    wide = F.ceil(F.col("all") * 16 / spec.window)
    part = F.pmod(F.xxhash64("group"), F.lit(16 * parts)) + F.when(wide > 1, F.pmod("salt", wide)).otherwise(0)
    first = F.when(F.col("linked") == 1, F.pmod(part, F.lit(16 * parts))).otherwise(16 * parts + F.pmod("salt", F.lit(parts)))
    rows = rows.withColumn("unit", first)
    units = rows.groupBy("shard", "unit").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    units = materialise(units.withColumn("before", before), "units", n)
    load = {r["shard"]: r["n"] for r in units.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    share = [n // spec.shards + (s < n % spec.shards) for s in range(spec.shards)]
    filled = [min(load.get(s, 0), share[s]) for s in range(spec.shards)]
    beyond = [sum(max(0, load.get(x, 0) - share[x]) for x in range(s)) for s in range(spec.shards)]
    places = [sum(share[x] - filled[x] for x in range(s)) for s in range(spec.shards + 1)]
    order = Window.partitionBy("shard", "unit").orderBy("group", "id")
    ranked = rows.withColumn("in", F.row_number().over(order) - 1).join(units.select("shard", "unit", "before"), ["shard", "unit"])
    rank = F.col("before") + F.col("in")
    over = _pick(beyond, F.col("shard")) + rank - _pick(share, F.col("shard"))
    goal = sum((F.when(F.col("over") >= places[s], 1).otherwise(0) for s in range(1, spec.shards)), F.lit(0))
    ranked = ranked.withColumn("rank", rank).withColumn("over", F.when(rank >= _pick(share, F.col("shard")), over)).withColumn("goal", goal)
    stays = F.col("over").isNull()
    shard = F.when(stays, F.col("shard")).otherwise(F.col("goal")).cast("int")
    slot = F.when(stays, F.col("rank")).otherwise(_pick(filled, F.col("goal")) + F.col("over") - _pick(places[:-1], F.col("goal")))
    return ranked.withColumn("slot", slot.cast("long")).withColumn("shard", shard).drop("start", "salt", "linked", "all", "unit", "in", "before", "rank", "over", "goal")


def cut_groups(sharded: DataFrame) -> DataFrame:
    """One row: linked groups, groups in more than one shard, and links lost, counting a group as a path."""
    each = sharded.where(F.col("group").isNotNull()).groupBy("group").agg(F.count("*").alias("n"), F.min("shard").alias("a"), F.max("shard").alias("b"), F.size(F.collect_set("shard")).alias("k")).where(F.col("n") > 1)
    return each.agg(F.count("*").alias("groups"), F.count(F.when(F.col("a") != F.col("b"), 1)).alias("cut"), F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("lost_links"))


def op6_balanced_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard, of sixteen; shards differ by at most one row."""
    text = F.col("text").cast("binary")
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("group"),
    )
    found = balanced_shards(rows)
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
