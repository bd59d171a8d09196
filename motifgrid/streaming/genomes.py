"""Searching FASTA files as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import search
from ..operators.tiling import TILE
from ..plans.spec import SearchSpec
from ..sources.genome import fasta_records


def stream_fasta(spark: SparkSession, folder: str, files_a_batch: int = 16) -> DataFrame:
    """A streaming genome of the `.fa` files of a folder; each file is read once, when it appears."""
    text = spark.readStream.format("text").option("lineSep", "\n>").option("pathGlobFilter", "*.fa").option("maxFilesPerTrigger", files_a_batch).load(folder)
    return fasta_records(text).withColumn("chr_ord", F.xxhash64("chr_name"))


def stream_search(genome: DataFrame, spec: SearchSpec, size: int = TILE) -> DataFrame:
    """search() of a streaming genome: no state, so rows come in append mode as soon as a file is read."""
    return search(genome, spec, size)
