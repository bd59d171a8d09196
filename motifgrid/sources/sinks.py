"""Where sites go: a report of eight tab-separated columns, and a log of the run."""

from __future__ import annotations

import itertools
import json
import sys
import uuid
from dataclasses import dataclass, fields
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.spec import SearchSpec
from .scratch import scratch_folder

#: The header of the report.
HEADER = "#Bulge type\tcrRNA\tDNA\tChromosome\tPosition\tDirection\tMismatches\tBulge Size"


def report_lines(sites: DataFrame) -> DataFrame:
    """One line of text a site, for the columns of search()."""
    return sites.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in ("bulge_type", "crrna", "dna", "chromosome", "position", "direction", "mismatches", "bulge_size"))).alias("value"))


def write_report(sites: DataFrame, path: str) -> int:
    """Writes the header and all sites, in no order, to a file, or to the standard output for `-`; returns their number.

    A file's lines are written by all tasks to the session's shared folder and then
    joined byte by byte, so the search runs in parallel and the driver holds none of
    them. Lines for the standard output are fetched a partition at a time.
    """
    lines = report_lines(sites)
    if path == "-":
        n = 0
        sys.stdout.write(HEADER + "\n")
        for n, row in enumerate(lines.toLocalIterator(prefetchPartitions=True), 1):
            sys.stdout.write(row.value + "\n")
        sys.stdout.flush()
        return n
    spark = sites.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    with open(path, "w", encoding="utf-8") as out:  # before the search: a path that can't be written is an error at once
        out.write(HEADER + "\n")
    folder = jvm.org.apache.hadoop.fs.Path(f"{scratch_folder(spark)}/report-{uuid.uuid4().hex}")
    system = folder.getFileSystem(conf)
    try:
        lines.write.text(folder.toString())
        joined = jvm.java.io.FileOutputStream(path, True)
        try:
            for status in system.listStatus(folder):
                if status.getPath().getName().startswith("part-"):
                    part = system.open(status.getPath())
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, joined, conf, False)
                    part.close()
        finally:
            joined.close()
        return spark.read.text(folder.toString()).count()
    finally:
        system.delete(folder, True)


def write_parts(sites: DataFrame, folder: str) -> None:
    """The report as a folder of files, each with the header, written by the executors."""

    def headed(batches):
        for column in itertools.chain([pa.array([HEADER])], (batch["value"] for batch in batches)):
            yield pa.RecordBatch.from_arrays([column], names=["value"])

    report_lines(sites).mapInArrow(headed, "value string").write.text(folder)


@dataclass(frozen=True)
class RunLog:
    genome_path: str
    genome_bytes: int
    spec: SearchSpec
    device: str
    matches: int
    seconds: float

    def text(self) -> str:
        """What was searched, for what, by which scan and with what result: one JSON object, times in UTC."""
        ended = datetime.now(timezone.utc)
        spec = {f.name: getattr(self.spec, f.name) for f in fields(self.spec)}
        found = {
            "ended": ended.isoformat(timespec="seconds"), "seconds": round(self.seconds, 3), "matches": self.matches,
            "scan": "alignments with bulges" if self.spec.bulges else "mismatches", "device": self.device,
            "genome": {"path": self.genome_path, "bytes": self.genome_bytes}, "query": spec,
        }
        return json.dumps(found, indent=1) + "\n"


def write_log(out_path: str, log: RunLog) -> str | None:
    """Writes `<out_path>.log` unless the report went to the standard output; a failure is a warning."""
    if out_path == "-":
        return None
    try:
        with open(f"{out_path}.log", "w", encoding="utf-8") as file:
            file.write(log.text())
    except OSError as e:
        print(f"warning: the log wasn't written: {e}", file=sys.stderr)
        return None
    return f"{out_path}.log"
