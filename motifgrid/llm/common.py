"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches of at most `rows` rows, so that long texts don't fill a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def large_batches(spark: SparkSession, rows: int = 1 << 14):
    """Arrow batches of up to `rows` rows for what runs inside, whose rows are short."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def lean(run):
    """run, a function of Arrow batches; when it ends, its worker gives the system back what is free.

    Workers wait for other stages with all that they ever took, and one stage may leave several of them.
    """

    def lean_run(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

    return lean_run


def trim_jvm(spark: SparkSession) -> bool:
    """Has the driver's JVM give the system back what its threads and compilers have freed; False if it can't (before Java 17.0.9, or not on Linux)."""
    jvm, new_array = spark._jvm, spark.sparkContext._gateway.new_array
    kind = jvm.java.lang.Class
    try:
        types, values = new_array(kind, 4), new_array(jvm.java.lang.Object, 4)
        for k, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            types[k] = kind.forName(name)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # The server's own class isn't open to calls from outside, its interface is.
        kind.forName("javax.management.MBeanServer").getMethod("invoke", types).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:
        return False
    return True


#: Seconds between two releases, which take some 0.6 s.
RELEASE_S = 5
_released = 0.0


def release(spark: SparkSession) -> None:
    """Gives back what finished steps have left, at most every RELEASE_S seconds.

    Spark deletes a step's shuffle files and broadcasts when the driver happens to
    collect the objects that stand for them, which a heap with room puts off; and the
    many threads of large plans leave the driver with freed memory that it keeps.
    """
    global _released
    if time.monotonic() - _released < RELEASE_S:
        return
    gc.collect()
    spark._jvm.System.gc()
    trim_jvm(spark)
    _released = time.monotonic()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir.

    Where none is named, a temporary folder if all executors are threads of this
    process, as in tests; else an error, since executors don't share such a folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='motifgrid-')}")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Rows of a small result, and rows at most, that one written file may hold.
ROWS_A_FILE, MOST_ROWS_A_FILE = 25_000, 1_000_000


def materialise(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes df to the shared checkpoint folder and rereads it.

    This cuts the lineage with data that outlive any executor, so an iteration
    neither recomputes its past nor depends on blocks kept by one machine. rows:
    about how many there are at most, if known; then the result, computed by as
    many tasks as ever, is dealt to few files.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if rows is not None:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartition(max(1, min(parts, -(-rows // ROWS_A_FILE)), -(-rows // MOST_ROWS_A_FILE)))
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.scratch_path = path
    release(spark)
    return found


def discard(*frames: DataFrame) -> None:
    """Deletes what materialise() wrote, once nothing reads it any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of the largest membership sieve: 8 MB wherever it is sent.
SIEVE_BITS = 1 << 26


class Bloom:
    """A sent Bloom filter of numbers: it may name some that aren't there, and never misses one that is."""

    def __init__(self, sent, bits: int):
        self.sent, self.bits = sent, bits

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Whether each of keys, 64-bit numbers, may be there."""
        there = np.ones(len(keys), bool)
        for salt in _SALTS:
            p = _places(keys.view(np.uint64), salt, self.bits)
            there &= (self.sent.value[p >> 5] >> (p & 31).astype(np.uint32)) & np.uint32(1) > 0
        return there

    def _known(self, column: pa.Array) -> np.ndarray:
        return column.is_valid().to_numpy(zero_copy_only=False) & self.has(column.fill_null(0).to_numpy())

    def inside(self, key: str):
        """What hands on the rows of batches whose key may be there."""

        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array(self._known(batch[key])))

        return run

    def outside(self, batches, key: str):
        """The rows of batches whose key is null or isn't there."""
        for batch in batches:
            yield batch.filter(pa.array(~self._known(batch[key])))


_SALTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _places(h: np.ndarray, salt: int, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(salt)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)


def bloom(keys: DataFrame, key: str) -> Bloom:
    """A Bloom filter of keys(key), numbers, of at most SIEVE_BITS bits; past its size it only holds back fewer of the others.

    Every task makes the words that it sets, words are joined before the driver gets
    them: at most SIEVE_BITS / 32 numbers.
    """
    n = keys.count()
    bits = 1 << max(10, min(SIEVE_BITS.bit_length() - 1, (16 * n).bit_length()))

    def words(batches):
        own = np.zeros(bits // 32, np.uint32)
        for batch in batches:
            h = batch[key].drop_null().to_numpy().view(np.uint64)
            for salt in _SALTS:
                p = _places(h, salt, bits)
                np.bitwise_or.at(own, p >> 5, np.uint32(1) << (p & 31).astype(np.uint32))
        at = np.flatnonzero(own)
        for a in range(0, len(at), 1 << 16):
            part = at[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(own[part].astype(np.int64))], names=["w", "b"])

    found = keys.select(F.col(key).cast("long").alias(key)).mapInArrow(words, "w int, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table_ = np.zeros(bits // 32, np.uint32)
    table_[found["w"].to_numpy()] = found["b"].to_numpy().astype(np.uint32)
    return Bloom(keys.sparkSession.sparkContext.broadcast(table_), bits)


def sieve(rows: DataFrame, keys: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows(key, columns...) without most of those whose key isn't in keys(key): it spares the join that follows the shuffle of rows that it would drop."""
    own = rows.where(F.col(key).isNotNull()).select(key, *columns, F.xxhash64(key).alias("sieve_key"))
    return own.mapInArrow(bloom(keys.select(F.xxhash64(key).alias("sieve_key")), "sieve_key").inside("sieve_key"), own.schema).drop("sieve_key")


def sorted_groups(batches, keys: list[str]):
    """(key, rows) of successive rows with equal keys, which the batches hold in sorted order."""
    key, held = None, []
    for batch in batches:
        rows = list(zip(*(batch[c].to_pylist() for c in keys)))
        starts = [0, *(k for k in range(1, len(rows)) if rows[k] != rows[k - 1]), len(rows)]
        for x, y in zip(starts, starts[1:]):
            if y > x and rows[x] != key:
                if held:
                    yield key, pa.Table.from_batches(held)
                key, held = rows[x], []
            held.append(batch.slice(x, y - x))
    if held and key is not None:
        yield key, pa.Table.from_batches(held)


def in_blocks(rows: DataFrame, group: str, block: int) -> DataFrame:
    """rows with `class` and `size`, dealt so that any two of a group meet in one (group, i, j): a group of k blocks sends a row to the k pairs that hold its own."""
    rows = rows.withColumn("n_blocks", F.ceil(F.col("size") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("class"), F.col("n_blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    rows = rows.drop("n_blocks", "other", "size")
    return rows.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j")
