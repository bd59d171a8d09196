"""Genomes as DataFrames (chr_ord, chr_name, seq): FASTA files, folders of them, and 2bit files.

Paths are read by Spark, so they may be in any store that it reaches.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alphabet import LETTER, N, unpack_bases
from ..operators.tiling import TILE, tile
from ..plans.spec import BadFileFormat

GENOME = "chr_ord long, chr_name string, seq binary"
MAGIC = 0x1A412743


def _open(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def is_folder(spark: SparkSession, path: str) -> bool:
    system, where = _open(spark, path)
    return system.getFileStatus(where).isDirectory()


def _files(spark: SparkSession, path: str) -> list[str]:
    """The files of a folder whose names end with .fa, without those of folders in it; or the file itself."""
    system, where = _open(spark, path)
    if not system.getFileStatus(where).isDirectory():
        return [path]
    found = [s.getPath() for s in system.listStatus(where) if s.isFile() and s.getPath().getName().endswith(".fa")]
    return [f.toString() for f in found]


def first_byte(spark: SparkSession, path: str) -> int:
    """The first byte of a file, -1 if it is empty."""
    system, where = _open(spark, path)
    stream = system.open(where)
    try:
        return stream.read()
    finally:
        stream.close()


def fasta_records(text: DataFrame, max_line: int | None = None) -> DataFrame:
    """(chr_name, seq) of a column `value` of records, as cut at `\\n>`; sequences without bases are left out.

    The name is the whole header; line ends of either kind are taken out. A sequence
    with lines but without a name fails the query, and so does a line of more than
    max_line bases, if there is such a limit.
    """
    value = F.regexp_replace("value", "^>", "")
    rows = text.select(F.substring_index(value, "\n", 1).alias("head"), value.alias("value"))
    rows = rows.select(F.regexp_replace("head", "\r$", "").alias("chr_name"), F.when(F.instr("value", "\n") > 0, F.expr("substring(value, length(head) + 2)")).otherwise("").alias("body"))
    nameless = (F.col("chr_name") == "") & (F.col("body") != "")
    body = F.when(nameless, F.raise_error(F.lit("a sequence has no name")).cast("string")).otherwise(F.col("body"))
    if max_line is not None:
        long = F.exists(F.split("body", "\r?\n|\r$"), lambda line: F.length(line) > max_line)
        body = F.when(long, F.raise_error(F.lit(f"a line has more than {max_line} bases")).cast("string")).otherwise(body)
    return rows.select("chr_name", F.regexp_replace(body, "\r?\n|\r$", "").cast("binary").alias("seq")).where(F.length("seq") > 0)


def read_fasta(spark: SparkSession, path: str, max_line: int | None = None) -> DataFrame:
    """Sequences of a FASTA file, or of all `.fa` files of a folder, numbered apart even if their names are equal."""
    files = _files(spark, path)
    for file in files:
        if first_byte(spark, file) not in (-1, ord(">")):
            raise BadFileFormat(f"{file}: a FASTA file starts with >")
    if not files:
        return spark.createDataFrame([], GENOME)
    records = fasta_records(spark.read.text(files, lineSep="\n>"), max_line)
    return records.select(F.monotonically_increasing_id().alias("chr_ord"), "chr_name", "seq")


def parse_2bit(data: bytes):
    """(name, letters) of each sequence of a 2bit file, in the order of its index; letters are upper case."""
    view = memoryview(data)

    def numbers(n: int) -> np.ndarray:
        nonlocal at
        if at + 4 * n > len(view):
            raise BadFileFormat("a 2bit file ends too soon")
        found = np.frombuffer(view[at : at + 4 * n], "=u4")
        at += 4 * n
        return found.astype(np.int64)

    at = 0
    magic, version, count, _ = numbers(4).tolist()
    if magic != MAGIC:
        raise BadFileFormat("not a 2bit file of this machine's byte order")
    if version:
        raise BadFileFormat(f"2bit version {version} is unknown")
    names = []
    for _ in range(count):
        n = view[at] if at < len(view) else 0
        names.append(bytes(view[at + 1 : at + 1 + n]).decode("utf-8"))
        at += 1 + n
        numbers(1)  # the records follow each other in the index's order
    for name in names:
        (size,) = numbers(1).tolist()
        blocks = []
        for _ in range(2):  # runs of N, then of lower case
            (n,) = numbers(1).tolist()
            blocks.append((numbers(n), numbers(n)))
        numbers(1)
        packed = -(-size // 4)
        if at + packed > len(view):
            raise BadFileFormat("a 2bit file ends too soon")
        codes = unpack_bases(view[at : at + packed], size)
        at += packed
        for start, length in zip(*blocks[0]):
            codes[start : start + length] = N
        yield name, LETTER[codes].tobytes()


#: The two bits of each letter; those of others are as T's.
_BITS = np.zeros(256, np.uint8)
_BITS[[ord(c) for c in "TCAG"]] = np.arange(4)


def _record_2bit(text: str) -> bytes:
    """The record of a sequence in a 2bit file."""
    letters = np.frombuffer(text.upper().encode("ascii", "replace"), np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (letters == ord("N")).view(np.int8), [0]])))
    starts, ends = edges[::2].astype("=u4"), edges[1::2].astype("=u4")
    bits = np.zeros(-(-len(letters) // 4) * 4, np.uint8)
    bits[: len(letters)] = _BITS[letters]
    packed = bits[0::4] << 6 | bits[1::4] << 4 | bits[2::4] << 2 | bits[3::4]
    return b"".join((struct.pack("=II", len(letters), len(starts)), starts.tobytes(), (ends - starts).tobytes(), struct.pack("=II", 0, 0), packed.tobytes()))


def _file_2bit(names: list[bytes], records: list[bytes]) -> bytes:
    index, at = [], 16 + sum(5 + len(n) for n in names)
    for name, record in zip(names, records):
        index.append(struct.pack("=B", len(name)) + name + struct.pack("=I", at))
        at += len(record)
    return b"".join((struct.pack("=IIII", MAGIC, 0, len(names), 0), *index, *records))


def write_2bit(sequences: list[tuple[str, str]]) -> bytes:
    """A 2bit file of sequences of A, C, G, T and N."""
    return _file_2bit([n.encode() for n, _ in sequences], [_record_2bit(t) for _, t in sequences])


def files_2bit(sequences: Iterable[tuple[str, str]], limit: int = 1 << 25) -> Iterator[bytes]:
    """2bit files of all sequences, in their order, each of about `limit` bytes or of one sequence."""
    names, records, size = [], [], 0
    for name, text in sequences:
        record = _record_2bit(text)
        if names and size + len(record) > limit:
            yield _file_2bit(names, records)
            names, records, size = [], [], 0
        names.append(name.encode())
        records.append(record)
        size += len(record)
    if names:
        yield _file_2bit(names, records)


@dataclass(frozen=True)
class Record:
    """Where a sequence of a 2bit file lies: its bases, its runs of N, and the bytes of its bases."""

    number: int
    name: str
    size: int
    runs_at: int
    runs: int
    bases_at: int


def _range(path: str):
    """What opens a path for reads of byte ranges, if this process reaches its store by itself; else None."""
    try:
        system, where = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)
        system.get_file_info(where)
        return lambda: system.open_input_file(where)
    except (pa.ArrowException, OSError, ImportError):
        return None


class _Ahead:
    """An open file whose small reads are served from `window` bytes read at a time."""

    def __init__(self, file, window: int):
        self.file, self.window, self.at, self.held = file, window, 0, b""

    def size(self) -> int:
        return self.file.size()

    def read_at(self, n: int, at: int) -> bytes:
        if at < self.at or at + n > self.at + len(self.held):
            self.at, self.held = at, self.file.read_at(max(n, self.window), at)
        return self.held[at - self.at : at - self.at + n]


def _numbers(file, at: int, n: int) -> np.ndarray:
    raw = file.read_at(4 * n, at)
    if len(raw) < 4 * n:
        raise BadFileFormat("a 2bit file ends too soon")
    return np.frombuffer(raw, "=u4").astype(np.int64)


def records_2bit(file) -> list[Record]:
    """The records of an open 2bit file: its index, and the head of each sequence."""
    file = _Ahead(file, 1 << 14)
    magic, version, count, _ = _numbers(file, 0, 4).tolist()
    if magic != MAGIC:
        raise BadFileFormat("not a 2bit file of this machine's byte order")
    if version:
        raise BadFileFormat(f"2bit version {version} is unknown")
    at, places, found, size = 16, [], [], file.size()
    for _ in range(count):
        n = (file.read_at(1, at) or b"\0")[0]
        name = file.read_at(n, at + 1).decode("utf-8")
        places.append((name, *_numbers(file, at + 1 + n, 1).tolist()))
        at += 5 + n
    for number, (name, place) in enumerate(places):
        bases, runs = _numbers(file, place, 2).tolist()
        masks_at = place + 8 + 8 * runs
        bases_at = masks_at + 8 + 8 * int(_numbers(file, masks_at, 1)[0])
        if bases_at + -(-bases // 4) > size:
            raise BadFileFormat("a 2bit file ends too soon")
        found.append(Record(number, name, bases, place + 8, runs, bases_at))
    return found


def _runs(file, record: Record) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of a record's runs of N."""
    n = _numbers(file, record.runs_at, 2 * record.runs)
    return n[: record.runs], n[record.runs :]


def _bases(file, record: Record, runs: tuple[np.ndarray, np.ndarray], start: int, stop: int) -> bytes:
    """Letters [start, stop) of a record."""
    first = start // 4
    raw = file.read_at(-(-stop // 4) - first, record.bases_at + first)
    codes = unpack_bases(memoryview(raw), stop - 4 * first)[start - 4 * first :].copy()
    if len(runs[0]):
        begin, end = np.clip(runs[0] - start, 0, len(codes)), np.clip(runs[0] + runs[1] - start, 0, len(codes))
        depth = np.bincount(begin, minlength=len(codes) + 1) - np.bincount(end, minlength=len(codes) + 1)
        codes[np.cumsum(depth[:-1]) > 0] = N
    return LETTER[codes].tobytes()


def tiles_2bit(spark: SparkSession, path: str, overlap: int = 0, size: int = TILE, parts: int | None = None) -> DataFrame | None:
    """The tiles of a 2bit file, as tiling.tile() makes them: every task reads the bytes of its own.

    The driver reads the index and the sequences' heads, a few numbers each. None if
    Python doesn't reach the path's store by itself.
    """
    if (opened := _range(path)) is None:
        return None
    with opened() as file:
        records = records_2bit(file)
    parts = parts or max(spark.sparkContext.defaultParallelism, sum(r.size for r in records) >> 24)
    rows = spark.createDataFrame([tuple(vars(r).values()) for r in records if r.size], "number long, name string, size long, runs_at long, runs long, bases_at long")
    dealt = rows.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(size).cast("long")))).repartition(parts)

    def read(batches):
        with _range(path)() as file:
            held, runs = None, None
            for batch in batches:
                for *record, start in zip(*(batch[c].to_pylist() for c in batch.schema.names)):
                    record = Record(*record)
                    if record != held:
                        held, runs = record, _runs(file, record)
                    own = min(size, record.size - start)
                    seq = _bases(file, record, runs, start, min(record.size, start + own + overlap))
                    yield pa.RecordBatch.from_arrays([pa.array([record.number], pa.int64()), pa.array([record.name]), pa.array([start], pa.int64()), pa.array([own], pa.int32()), pa.array([seq], pa.binary())], names=["chr_ord", "chr_name", "tile_start", "own", "seq"])

    return dealt.mapInArrow(read, "chr_ord long, chr_name string, tile_start long, own int, seq binary")


def read_2bit(spark: SparkSession, path: str) -> DataFrame:
    """Sequences of a 2bit file, each read by a task of its own; N runs are N, lower case is lost.

    From a store that only Spark reaches the file is one row and one task's work, and
    at most 2 GB. A search of a file needs no whole sequences: see tiles_2bit().
    """
    if _range(path) is not None:
        longest = (1 << 31) - 8192
        return tiles_2bit(spark, path, size=longest).select("chr_ord", "chr_name", "seq")

    def read(batches):
        for batch in batches:
            for data in batch["content"]:
                for k, (name, seq) in enumerate(parse_2bit(data.as_py())):
                    if seq:
                        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([name]), pa.array([seq], pa.binary())], names=["chr_ord", "chr_name", "seq"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, GENOME)


def read_2bit_files(spark: SparkSession, paths: list[str], part: int = 1 << 25, batch: int = 1 << 22) -> DataFrame:
    """Sequences of many 2bit files, of any number of sequences each.

    A task reads the sequences whose bases begin in its part of a file, of about
    `part` bytes, and hands on about `batch` bases at a time; it reads the index by
    itself, and the driver only the files' sizes. From a store that only Spark reaches
    a file is a task's work, as for read_2bit().
    """
    if not paths:
        return spark.createDataFrame([], GENOME)
    if any(_range(path) is None for path in paths):
        numbered = (read_2bit(spark, path).withColumn("chr_ord", F.col("chr_ord") + F.lit(k << 32)) for k, path in enumerate(paths))
        return reduce(DataFrame.unionByName, numbered)
    dealt = []
    for k, path in enumerate(paths):
        with _range(path)() as file:
            size = file.size()
        dealt += [(k, path, at, at + part) for at in range(0, max(size, 1), part)]

    def read(batches):
        for rows in batches:
            for k, path, low, high in zip(*(rows[c].to_pylist() for c in ("k", "path", "low", "high"))):
                with _range(path)() as file:
                    ahead, held, size = _Ahead(file, 1 << 20), [], 0
                    for record in sorted((r for r in records_2bit(file) if r.size and low <= r.bases_at < high), key=lambda r: r.bases_at):
                        held.append((k << 32 | record.number, record.name, _bases(ahead, record, _runs(ahead, record), 0, record.size)))
                        size += record.size
                        if size >= batch:
                            yield _genome_batch(held)
                            held, size = [], 0
                    if held:
                        yield _genome_batch(held)

    rows = spark.createDataFrame(spark.sparkContext.parallelize(dealt, len(dealt)), "k long, path string, low long, high long")
    return rows.mapInArrow(read, GENOME)


def _genome_batch(rows: list[tuple[int, str, bytes]]) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.binary()))]
    return pa.RecordBatch.from_arrays(columns, names=["chr_ord", "chr_name", "seq"])


def is_fasta(spark: SparkSession, path: str) -> bool:
    return is_folder(spark, path) or first_byte(spark, path) == ord(">")


def read_genome(spark: SparkSession, path: str) -> DataFrame:
    """A folder of FASTA files, a FASTA file (it begins with >), or else a 2bit file."""
    return read_fasta(spark, path) if is_fasta(spark, path) else read_2bit(spark, path)


def read_tiles(spark: SparkSession, path: str, overlap: int = 0, size: int = TILE) -> DataFrame:
    """The tiles of a genome's files, dealt over all tasks whatever the sequences' sizes."""
    if not is_fasta(spark, path) and (found := tiles_2bit(spark, path, overlap, size)) is not None:
        return found
    return tile(read_genome(spark, path), overlap, size, spark.sparkContext.defaultParallelism)
