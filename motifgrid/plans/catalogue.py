"""The named queries of the sequence search over the driver's tables, each with its SQL.

The genome is made of documents: letters alone, upper case, each letter that isn't a
base replaced by a fixed one; every document is a sequence.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alphabet as a
from ..functions.align import best_alignment_column, edit_distance_column
from ..operators.search import find_sites, search, summary
from ..operators.tiling import tile
from ..sources.sinks import report_lines
from ..sources.scratch import scratch_folder
from . import sql
from .spec import SearchSpec, parse_query

GUIDES = ("TGCTGATACTCCCTGCTAACNNN", "TAGCTCTTGCTGGCCGAGGANNN")


def made_up_guides(n: int, length: int = 20, motif: str = "NNN") -> tuple[str, ...]:
    """n different guides, the same on every machine: letters from a linear congruence."""
    state, out = 1, []
    for _ in range(n):
        letters = ""
        for _ in range(length):
            state = (state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
            letters += "ACGT"[state >> 62]
        out.append(letters + motif)
    return tuple(out)


NRG = SearchSpec("N" * 21 + "RG", GUIDES, 7)
SPECS = {
    "mismatch_scan_nrg": NRG,
    "mismatch_scan_pam_first": SearchSpec("TTTN" + "N" * 20, ("NNNNATTTTGTTCGCTGATGATGA",), 9),
    "mismatch_scan_multi_guide": SearchSpec("N" * 21 + "GG", (*GUIDES, "TGGTCTGTTAAGAAGTTAAANNN", "ACCGTAGGGGTAATTAAGTTNNN", "GACAAGTTGATTCTTCTGTTNNN", GUIDES[0]), 8),
    "mismatch_scan_100_guides": SearchSpec("N" * 21 + "GG", made_up_guides(100), 8),
    "mismatch_scan_25mers_six_letter_pam": SearchSpec("N" * 25 + "NNGRRT", made_up_guides(4, 25, "NNNNNN"), 14),
    "mismatch_scan_no_pam": SearchSpec("N" * 12, ("TGCTGATACTCC",), 2),
    "mismatch_iupac_guide": SearchSpec("N" * 13 + "NGG", ("TRCYGSWKCMBNDNNN",), 1),
    "mismatch_genome_n": SearchSpec("N" * 11, ("TGCTNNNNTAC",), 2),
    "mismatch_reported_gate": SearchSpec("N" * 11, ("TGCTNNNNTAC",), 1, strict_gate=False),
    "bulge_dna1": SearchSpec("N" * 14 + "RG", ("GGAGCTAATACTCNNN",), 2, 1, 0),
    "bulge_rna1": SearchSpec("N" * 14 + "RG", ("CCCTGCTAACGTANNN",), 2, 0, 1),
    "bulge_dna1_rna1": SearchSpec("N" * 10 + "GG", ("TAGCTCTTGNNN",), 1, 1, 1),
    "bulge_pam_first": SearchSpec("TTTN" + "N" * 10, ("NNNNATTTTGTTCG",), 1, 1, 1),
    "bulge_dna2": SearchSpec("N" * 11 + "GG", ("TTGCTGGCCGNNN",), 1, 2, 0),
}
PROBE = "TGCTNATACT"


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    return docs.select("doc_id", F.concat(F.lit("doc"), "doc_id").alias("chr_name"), F.translate(letters, sql.LETTERS_FROM, sql.LETTERS_TO).alias("seq"))


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genome(spark, sf_dir).select(F.col("doc_id").alias("chr_ord"), "chr_name", "seq")


def _genome_query(spark, sf_dir):
    return genome(spark, sf_dir).select("chr_name", F.length("seq").cast("long").alias("n"), F.md5(F.col("seq").cast("binary")).alias("seq_md5"))


def _tiles_query(spark, sf_dir):
    rows = tile(_sequences(spark, sf_dir), overlap=24, size=1000)
    return rows.select("chr_name", "tile_start", "own", F.md5("seq").alias("seq_md5"))


def _reverse_query(spark, sf_dir):
    seq = F.col("seq")
    return genome(spark, sf_dir).select("chr_name", F.md5(a.complement_column(seq).cast("binary")).alias("complement_md5"), F.md5(a.reverse_complement_column(seq).cast("binary")).alias("reverse_md5"))


def _words(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.explode(F.split("text", "[^A-Za-z]+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


_WORDS = "words AS (SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '[^A-Za-z]+')) AS word FROM documents) WHERE word <> '' GROUP BY word)"


def _validate_query(spark, sf_dir):
    return _words(spark, sf_dir).select("word", "n", a.is_mixed_base_column(F.col("word")).alias("mixed_base"))


def _orientation_query(spark, sf_dir):
    motif = F.translate(F.upper("word"), "EINOS", "NNNNN")
    first, length = a.motif_orientation_column(motif)
    rows = _words(spark, sf_dir).select("word", motif.alias("motif"), first.alias("motif_first"), length.alias("motif_length"))
    return rows.select("*", a.guide_column(F.col("word"), F.col("motif_first"), F.col("motif_length")).alias("guide"))


_ORIENTATION = f"""WITH {_WORDS},
m AS (SELECT word, translate(upper(word), 'EINOS', 'NNNNN') AS motif FROM words),
s AS (SELECT word, motif, length(motif) - length(ltrim(motif, 'N')) AS l, length(motif) - length(rtrim(motif, 'N')) AS r FROM m)
SELECT word, motif, l < r AS motif_first, (length(motif) - greatest(l, r))::INTEGER AS motif_length,
  CASE WHEN l < r THEN substr(word, length(motif) - r + 1) ELSE substr(word, 1, length(word) - (length(motif) - l)) END AS guide FROM s"""


def _codes_query(spark, sf_dir):
    letters = _words(spark, sf_dir).select(F.explode(F.split("word", "")).alias("letter"), "n").where("letter <> ''").groupBy("letter").agg(F.sum("n").alias("n"))
    code = a.code_column(F.col("letter"))
    return letters.select("letter", "n", code.alias("code"), F.when(code > 0, a.letter_column(code)).alias("canonical"))


_CODES = " ".join(f"WHEN '{k}' THEN {v}" for k, v in a.CODES.items())


def _starts(spark, sf_dir, both):
    """Places where the motif alone fits: the scan with a pattern of Ns and room for every N of the genome."""
    spec = SearchSpec("N" * 5 + "TGG", ("N" * 8,), 8)
    rows = find_sites(_sequences(spark, sf_dir), spec)
    rows = rows if both else rows.where("is_forward")
    return rows.select("chr_name", F.col("chrom_idx").alias("pos"), F.when(F.col("is_forward"), "+").otherwise("-").alias("dir"), F.upper("dna_seq").alias("x"))


def _label_query(spark, sf_dir):
    spec = SPECS["bulge_dna1_rna1"]
    return search(_sequences(spark, sf_dir), spec).groupBy("bulge_type", "direction", "bulge_size", "mismatches").agg(F.count("*").alias("sites"), F.min("position").alias("low"), F.max("position").alias("high"))


def _distance_query(spark, sf_dir):
    """Least edits between the probe and an end of each whole sequence."""
    return genome(spark, sf_dir).select(F.col("doc_id").alias("id"), F.length("seq").cast("long").alias("n"), edit_distance_column(PROBE, F.col("seq")).alias("distance"))


def _best_query(spark, sf_dir):
    return _whole_best_query(spark, sf_dir).select("id", "n", "distance")


def _whole_best_query(spark, sf_dir):
    """The best alignment with whole sequences, all of its parts."""
    found = best_alignment_column("TGCTGATACT", F.col("seq"), 99, 9, 9)
    rows = genome(spark, sf_dir).select(F.col("doc_id").alias("id"), F.length("seq").cast("long").alias("n"), found.alias("f"))
    parts = [F.col(f"f.{name}") for name in ("ops", "pattern_aligned", "text_aligned", "text_start", "mismatches", "dna_bulges", "rna_bulges")]
    return rows.select("id", "n", (F.col("f.mismatches") + F.col("f.dna_bulges") + F.col("f.rna_bulges")).alias("distance"), *parts)


#: A query as a file holds it.
QUERY_TEXT = f"genome\n{'N' * 21}GG 0 0\n{GUIDES[0]} 8 first\n{GUIDES[1].lower()} 8 second\n"
#: Headers of several words and both kinds of line ends.
HEADER_WORDS = " of the made genome"


def _query_text_query(spark, sf_dir):
    return search(_sequences(spark, sf_dir), parse_query(QUERY_TEXT).spec, spread=spark.sparkContext.defaultParallelism)


def _report_query(spark, sf_dir):
    return report_lines(search(_sequences(spark, sf_dir), NRG))


def _complement_query(spark, sf_dir):
    """Complements of words, whose letters are all that the code knows and others."""
    word = F.col("word")
    return _words(spark, sf_dir).select("word", "n", a.complement_column(word).alias("complement"), a.reverse_complement_column(word).alias("reversed"))


def _base_sets_query(spark, sf_dir):
    """Which bases each letter of the texts takes."""
    code = a.code_column(F.col("letter"))
    return _codes_query(spark, sf_dir).select("letter", *(code.bitwiseAND(F.lit(a.CODES[b])).cast("boolean").alias(f"takes_{b.lower()}") for b in "ACGT"))


def _fasta_query(spark, sf_dir, words="", end="\n"):
    """The genome written as FASTA in lines of 60 bases and read again."""
    from ..sources.genome import read_genome

    folder = f"{scratch_folder(spark)}/fasta-{uuid.uuid4().hex}"
    lines = genome(spark, sf_dir).where("seq <> ''").select(F.concat(F.lit(">"), "chr_name", F.lit(words + end), F.regexp_replace("seq", "(.{60})(?=.)", "$1" + end)).alias("value"))
    lines.write.mode("overwrite").text(folder)
    system = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for k, status in enumerate(system.listStatus(spark._jvm.org.apache.hadoop.fs.Path(folder))):
        if status.getPath().getName().startswith("part-"):
            system.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k}.fa"))
    return read_genome(spark, folder).select("chr_name", F.length("seq").cast("long").alias("n"), F.md5("seq").alias("seq_md5"))


def _twobit_query(spark, sf_dir):
    """The genome written as 2bit files of bounded size by all tasks, and read again by ranges."""
    import pyarrow as pa
    from pyarrow import fs

    from ..sources.genome import files_2bit, read_2bit_files

    folder = f"{scratch_folder(spark)}/2bit-{uuid.uuid4().hex}"

    def write(batches):
        system, where = fs.FileSystem.from_uri(folder)
        system.create_dir(where, recursive=True)
        for data in files_2bit((n.as_py(), s.as_py()) for batch in batches for n, s in zip(batch["chr_name"], batch["seq"])):
            name = f"{uuid.uuid4().hex}.2bit"  # of this attempt: a task may run twice
            with system.open_output_stream(f"{where}/{name}") as out:
                out.write(data)
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    rows = genome(spark, sf_dir).select("chr_name", "seq").where("seq IS NOT NULL")
    names = sorted(r["name"] for r in rows.repartition(max(4, spark.sparkContext.defaultParallelism), "chr_name").mapInArrow(write, "name string").collect())
    found = read_2bit_files(spark, [f"{folder}/{name}" for name in names])
    return found.select("chr_name", F.length("seq").cast("long").alias("n"), F.md5("seq").alias("seq_md5"))


def _site_query(spec: SearchSpec) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: search(_sequences(spark, sf_dir), spec, spread=spark.sparkContext.defaultParallelism)


def _site_sql(spec: SearchSpec) -> str:
    return sql.bulge_search(spec) if spec.bulges else sql.mismatch_search(spec)


def _summary_query(spark, sf_dir):
    return summary(find_sites(_sequences(spark, sf_dir), NRG), NRG)


_PLACES = sql.windows({8})
_FITS = "substr(x, 6, 3) = 'TGG'"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "genome_from_documents": _genome_query,
    "tile_genome": _tiles_query,
    "reverse_complement": _reverse_query,
    "iupac_validate": _validate_query,
    "nucleotide_codes": _codes_query,
    "pam_orientation_extract_guide": _orientation_query,
    "pam_sites_forward": lambda spark, sf_dir: _starts(spark, sf_dir, False),
    "pam_sites_both_strands": lambda spark, sf_dir: _starts(spark, sf_dir, True),
    **{name: _site_query(spec) for name, spec in SPECS.items()},
    "bulge_label_position": _label_query,
    "edit_distance_semiglobal": _distance_query,
    "best_alignment": _best_query,
    "fasta_roundtrip": _fasta_query,
    "fasta_headers_and_line_ends": lambda spark, sf_dir: _fasta_query(spark, sf_dir, HEADER_WORDS, "\r\n"),
    "twobit_roundtrip": _twobit_query,
    "query_text_search": _query_text_query,
    "report_lines": _report_query,
    "iupac_complement": _complement_query,
    "iupac_base_sets": _base_sets_query,
    "match_summary_by_guide": _summary_query,
}

#: Queries without SQL, for the order of ties among alignments. Tests hold them against brute force.
WHOLE: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "best_alignment_whole": _whole_best_query,
}

#: The letters that take each base.
_TAKERS = {"A": "ARWMDHVN", "C": "CYSMBHVN", "G": "GRSKBDVN", "T": "TYWKBDHN"}

ORACLES: dict[str, str] = {
    "genome_from_documents": f"SELECT chr_name, length(seq)::BIGINT AS n, md5(seq) AS seq_md5 FROM ({sql.GENOME})",
    "tile_genome": f"SELECT chr_name, t::BIGINT AS tile_start, least(1000, length(seq) - t)::INTEGER AS own, md5(substr(seq, t + 1, 1024)) AS seq_md5 FROM ({sql.GENOME}), unnest(range(0, length(seq), 1000)) AS u(t)",
    "reverse_complement": f"SELECT chr_name, md5(translate(seq, 'ACGT', 'TGCA')) AS complement_md5, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS reverse_md5 FROM ({sql.GENOME})",
    "iupac_validate": f"WITH {_WORDS} SELECT word, n, regexp_full_match(word, '(?i)[ACGTRYSWKMBDHVN]+') AS mixed_base FROM words",
    "nucleotide_codes": f"WITH {_WORDS}, letters AS (SELECT letter, sum(n)::BIGINT AS n FROM (SELECT unnest(string_split(word, '')) AS letter, n FROM words) WHERE letter <> '' GROUP BY letter) SELECT letter, n, (CASE upper(letter) {_CODES} ELSE 0 END)::INTEGER AS code, CASE WHEN strpos('{a.LETTERS}', upper(letter)) > 0 THEN upper(letter) END AS canonical FROM letters",
    "pam_orientation_extract_guide": _ORIENTATION,
    "pam_sites_forward": f"WITH {_PLACES} SELECT chr_name, pos::BIGINT AS pos, dir, x FROM w8 WHERE dir = '+' AND {_FITS}",
    "pam_sites_both_strands": f"WITH {_PLACES} SELECT chr_name, pos::BIGINT AS pos, dir, x FROM w8 WHERE {_FITS}",
    **{name: _site_sql(spec) for name, spec in SPECS.items()},
    "bulge_label_position": f"SELECT bulge_type, direction, bulge_size, mismatches, count(*)::BIGINT AS sites, min(position) AS low, max(position) AS high FROM ({_site_sql(SPECS['bulge_dna1_rna1'])}) GROUP BY ALL",
    "edit_distance_semiglobal": sql.semiglobal(PROBE),
    "best_alignment": sql.semiglobal("TGCTGATACT", loose=True),
    "fasta_roundtrip": f"SELECT chr_name, length(seq)::BIGINT AS n, md5(seq) AS seq_md5 FROM ({sql.GENOME}) WHERE seq <> ''",
    "fasta_headers_and_line_ends": f"SELECT chr_name || '{HEADER_WORDS}' AS chr_name, length(seq)::BIGINT AS n, md5(seq) AS seq_md5 FROM ({sql.GENOME}) WHERE seq <> ''",
    "query_text_search": sql.mismatch_search(SearchSpec("N" * 21 + "GG", GUIDES, 8)),
    "report_lines": f"SELECT concat_ws(chr(9), bulge_type, crrna, dna, chromosome, position, direction, mismatches, bulge_size) AS value FROM ({_site_sql(NRG)})",
    "iupac_complement": f"WITH {_WORDS}, c AS (SELECT word, n, translate(word, 'ACGTRYSWKMBDHVNacgtryswkmbdhvn', 'TGCAYRSWMKVHDBNtgcayrswmkvhdbn') AS complement FROM words) SELECT word, n, complement, reverse(complement) AS reversed FROM c",
    "iupac_base_sets": f"WITH {_WORDS} SELECT DISTINCT letter, " + ", ".join(f"strpos('{_TAKERS[b]}', upper(letter)) > 0 AS takes_{b.lower()}" for b in "ACGT") + " FROM (SELECT unnest(string_split(word, '')) AS letter FROM words) WHERE letter <> ''",
    "twobit_roundtrip": f"SELECT chr_name, length(seq)::BIGINT AS n, md5(seq) AS seq_md5 FROM ({sql.GENOME}) WHERE seq <> ''",
    "match_summary_by_guide": f"SELECT crrna, direction, bulge_size, mismatches, count(*)::BIGINT AS sites FROM ({_site_sql(NRG)}) GROUP BY ALL",
}
