"""The search: a genome and a specification in, sites out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alphabet import bulge_label, reported_position
from ..plans.spec import SearchSpec
from .bulge import scan_bulges
from .mismatch import scan_mismatches
from .tiling import TILE, tile


def find_sites(genome: DataFrame, spec: SearchSpec, size: int = TILE, spread: int | None = None) -> DataFrame:
    """Sites with the fields of block.MATCH, for genome(chr_name, seq, and chr_ord if there is one).

    Rows are a multiset without order: equal patterns give equal rows, and a pattern
    that is its own reverse complement is found on both strands.
    """
    return find_in_tiles(tile(genome, spec.overlap, size, spread), spec)


def find_in_tiles(tiles: DataFrame, spec: SearchSpec) -> DataFrame:
    """Sites in tiles that have spec.overlap bases more than their own."""
    return scan_bulges(tiles, spec) if spec.bulges else scan_mismatches(tiles, spec)


def report(sites: DataFrame, spec: SearchSpec) -> DataFrame:
    """Sites in the eight columns of the report."""
    dna, rna = F.col("dna_bulge_size"), F.col("rna_bulge_size")
    return sites.select(
        bulge_label(dna, rna).alias("bulge_type"),
        F.col("rna_seq").alias("crrna"),
        F.col("dna_seq").alias("dna"),
        F.col("chr_name").alias("chromosome"),
        reported_position(F.col("chrom_idx"), F.col("is_forward"), dna, spec.trailing).alias("position"),
        F.when(F.col("is_forward"), "+").otherwise("-").alias("direction"),
        "mismatches",
        (dna + rna).alias("bulge_size"),
    )


def search(genome: DataFrame, spec: SearchSpec, size: int = TILE, spread: int | None = None) -> DataFrame:
    """The report of all sites of the patterns in the genome."""
    return report(find_sites(genome, spec, size, spread), spec)


def search_files(spark: SparkSession, path: str, spec: SearchSpec, size: int = TILE) -> DataFrame:
    """The report of all sites in a genome's files, read and searched by all tasks."""
    from ..sources.genome import read_tiles

    return report(find_in_tiles(read_tiles(spark, path, spec.overlap, size), spec), spec)


def summary(sites: DataFrame, spec: SearchSpec) -> DataFrame:
    """Sites of each pattern by strand, bulges and mismatches."""
    pattern = F.pmod("pattern_idx", F.lit(len(spec.patterns)))
    rows = sites.groupBy(pattern.alias("pattern_idx"), "is_forward", (F.col("dna_bulge_size") + F.col("rna_bulge_size")).alias("bulge_size"), "mismatches").agg(F.count("*").alias("sites"))
    names = F.get(F.array(*(F.lit(p.upper()) for p in spec.patterns)), F.col("pattern_idx").cast("int"))
    return rows.select(names.alias("crrna"), F.when(F.col("is_forward"), "+").otherwise("-").alias("direction"), "bulge_size", "mismatches", "sites")
