"""python -m motifgrid.cli QUERY {C|G|A} OUT: search a genome for the patterns of a query file."""

from __future__ import annotations

import sys
import time

from pyspark.sql import SparkSession

from .operators.search import search_files
from .plans.spec import SearchError, parse_arguments, read_query
from .sources.genome import _files, _open
from .sources.sinks import RunLog, write_log, write_report

USAGE = """Usage: motifgrid QUERY DEVICE OUT
  QUERY   a query file, or - for the standard input:
            <genome: a FASTA file, a folder of .fa files, or a 2bit file>
            <motif> [<DNA bulges> <RNA bulges>]
            <pattern> <mismatches> [<label>]
            ...
  DEVICE  C, G or A; all of them run on Spark's executors
  OUT     the report's file, or - for the standard output
Available devices: Spark executors"""


def _session() -> SparkSession:
    return SparkSession.builder.appName("motifgrid").getOrCreate()


def main(args: list[str], spark: SparkSession | None = None) -> int:
    try:
        found = parse_arguments(args)
        if found is None:
            print(USAGE)
            return 0
        query = read_query(found.query)
        began = time.time()
        spark = spark or _session()
        n = write_report(search_files(spark, query.genome, query.spec), found.out)
        seconds = time.time() - began
        size = sum(system.getFileStatus(where).getLen() for system, where in (_open(spark, f) for f in _files(spark, query.genome)))
        write_log(found.out, RunLog(query.genome, size, query.spec, found.device, n, seconds))
        print(f"Completed in {seconds:.3f}s", file=sys.stderr)
        return 0
    except (SearchError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
