"""A corpus from raw documents to tokens: five stages, each one operator of motifgrid.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it
kept; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifgrid.llm import bpe, lines, mixing, setjoin, toxicity
from motifgrid.llm.common import discard, materialise, table

#: The stages' models and hashes aren't SQL; tests/llm hold each stage against a brute-force version.
ORACLE_SQL = None


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject."""
    model = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.reject_toxic(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones; one that keeps no word goes: all that it said stands elsewhere."""
    found = lines.drop_repeated_lines(docs)
    return found.where((F.col("n_removed") == 0) | (F.col("n_left") > 0)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each component of near copies."""
    found = setjoin.near_duplicates(docs.select("doc_id", "text"))
    copies = found.where(F.col("doc_id").isNotNull() & ~F.col("kept")).select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: a source weighs the square root of its rows."""
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, with digests of the ids and of the decoded bytes.

    mix_part and mix_row, the file and row that a document was read from, keep the
    order of the mix for whoever reads the tokens; they are null if docs isn't read
    from files.
    """
    try:
        rows = docs.select(F.col("doc_id").cast("long"), "text", F.col("_metadata.file_name").alias("mix_part"), F.col("_metadata.row_index").alias("mix_row"))
    except AnalysisException:
        rows = docs.select(F.col("doc_id").cast("long"), "text", F.lit(None).cast("string").alias("mix_part"), F.lit(None).cast("long").alias("mix_row"))
    return bpe.encode_documents(rows, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, bpe.tokens, bpe.TOKENS, keep=("mix_part", "mix_row"))


STAGES = [
    ("toxicity", toxicity_filter),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mixing", source_mix),
    ("tokenize", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over documents; each stage's rows are written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{k}")
            if k:
                discard(before)
    return docs
