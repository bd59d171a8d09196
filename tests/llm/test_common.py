import os
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from motifgrid.llm import common
from motifgrid.llm.common import bloom, checkpoint_dir, discard, materialise, sieve


def test_the_sieve_keeps_every_wanted_row(spark):
    rows = spark.range(20_000).select(F.col("id").alias("k"), F.concat(F.lit("t"), "id").alias("text")).union(spark.createDataFrame([(None, "x")], "k long, text string"))
    keys = spark.range(0, 20_000, 50).select(F.col("id").alias("k"))
    kept = sieve(rows, keys, "k", ["text"])
    found = {r["k"]: r["text"] for r in kept.collect()}
    assert all(found[k] == f"t{k}" for k in range(0, 20_000, 50)) and None not in found
    assert len(found) < 2000
    assert sieve(rows, keys.limit(0), "k", ["text"]).count() == 0
    binary = rows.select(F.col("text").cast("binary").alias("k"))
    assert sieve(binary, binary.limit(10), "k", []).count() >= 10


class Session:
    """A session that names a folder, or none."""

    def __init__(self, spark, folder, master="local[4]"):
        self.master, self.spark, self.conf, self.sparkContext, self.folder, self.own = master, spark, self, self, folder, None

    def get(self, key, default):
        assert key == "spark.checkpoint.dir"
        return self.folder

    def getCheckpointDir(self):
        return self.own

    def setCheckpointDir(self, folder):
        self.own = folder


def test_the_session_names_the_folder(spark):
    named = Session(spark, "hdfs://store/shared/")
    assert checkpoint_dir(named) == "hdfs://store/shared" and named.own is None
    bare = Session(spark, None)
    found = checkpoint_dir(bare)
    assert found.startswith("file:///") and checkpoint_dir(bare) == found == bare.own
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError):
            checkpoint_dir(Session(spark, None, master))


def test_a_bloom_filter_parts_rows(spark):
    known = bloom(spark.createDataFrame([(k * 7,) for k in range(300)] + [(None,)], "k long"), "k")
    batch = pa.RecordBatch.from_pydict({"k": pa.array([*range(2100), None], pa.int64())})
    inside, outside = (pa.Table.from_batches(x)["k"].to_pylist() for x in (known.inside("k")([batch]), known.outside([batch], "k")))
    assert set(range(0, 2100, 7)) <= set(inside) and len(inside) < 500 and None in outside
    assert sorted(inside) + sorted(x for x in outside if x is not None) and len(inside) + len(outside) == 2101


def test_materialised_rows_stay_until_discarded(spark):
    folder = checkpoint_dir(spark).removeprefix("file://")
    kept = materialise(spark.range(10, numPartitions=50).withColumn("x", F.lit(None).cast("string")), "numbers", 10)
    assert kept.scratch_path.startswith(folder + "/numbers-") or kept.scratch_path.startswith(checkpoint_dir(spark))
    assert kept.count() == 10 and kept.dtypes == [("id", "bigint"), ("x", "string")]
    where = kept.scratch_path.removeprefix("file://")
    assert len([n for n in os.listdir(where) if n.endswith(".parquet")]) == 1
    discard(kept)
    assert not os.path.exists(where)


def test_lean_functions_give_the_same_batches():
    assert list(common.lean(lambda batches: (2 * b for b in batches))(iter([1, 2, 3]))) == [2, 4, 6]
    assert list(common.lean(lambda batches: iter(()))(iter(()))) == []


def test_finished_steps_leave_no_shuffle_files(spark, monkeypatch):
    """What a written step has shuffled is deleted while later ones run, without waiting for a full heap."""
    monkeypatch.setattr(common, "RELEASE_S", 0, raising=False)

    def shuffled():
        found = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(k).getName() for k in range(found.size()) if found.apply(k).getName().startswith("shuffle_")}

    before = shuffled()
    first = materialise(spark.range(10_000).repartition(3, "id"), "released")
    own = shuffled() - before
    for _ in range(10):
        discard(materialise(spark.range(10), "later"))
        if not shuffled() & own:
            break
        time.sleep(0.2)
    assert not shuffled() & own and first.count() == 10_000
    discard(first)


def test_memory_of_the_driver_is_given_back_or_nothing_happens(spark, monkeypatch):
    assert common.trim_jvm(spark) in (True, False)
    calls = []
    monkeypatch.setattr(common, "trim_jvm", calls.append)
    monkeypatch.setattr(common, "_released", 0.0)
    for _ in range(3):
        common.release(spark)
    assert len(calls) == 1
