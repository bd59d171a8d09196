"""Tiles: sequences cut into rows of bounded size, each with the bases after it that a search needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 1 << 18


def tile(genome: DataFrame, overlap: int = 0, size: int = TILE, spread: int | None = None) -> DataFrame:
    """(chr_ord, chr_name, tile_start, own, seq) for genome(chr_name, seq, and chr_ord if there is one).

    A tile owns the starts in [tile_start, tile_start + own); seq holds those bases and
    up to `overlap` more of the same sequence, so every site starts in exactly one
    tile and lies wholly in it. Null and empty sequences have no tiles. Without
    chr_ord rows are numbered, so equal names stay apart. Nothing is shuffled, unless
    `spread` asks for so many partitions, dealt evenly whatever the sequences' sizes.
    """
    number = F.col("chr_ord").cast("long") if "chr_ord" in genome.columns else F.monotonically_increasing_id()
    rows = genome.select(number.alias("chr_ord"), "chr_name", F.col("seq").cast("binary").alias("whole")).where(F.length("whole") > 0)
    rows = rows.withColumn("tile_start", F.explode(F.sequence(F.lit(0), F.length("whole") - 1, F.lit(size))))
    own = F.least(F.lit(size), F.length("whole") - F.col("tile_start"))
    part = F.substring("whole", F.col("tile_start") + 1, F.lit(size + overlap))
    tiles = rows.select("chr_ord", "chr_name", F.col("tile_start").cast("long").alias("tile_start"), own.cast("int").alias("own"), part.alias("seq"))
    return tiles.repartition(spread) if spread else tiles
