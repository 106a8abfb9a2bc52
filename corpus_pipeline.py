"""A corpus from raw documents to packed sequences, in five stages.

Each stage works on all rows its predecessor kept. The stages before the last return the
columns of documents; the last returns the pieces of the kept documents, packed. A missing
doc_id or a repeated row is treated as the operators in chunkflow.llm state it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkflow.llm import decontam, lines, minhash, packing, quality
from chunkflow.llm._spark import materialize
from chunkflow.llm.tokens import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: those it scores below the threshold."""
    return quality.good_documents(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; so do documents of which no line with a word is left."""
    out = lines.dedup_lines(docs)
    whole = (F.col("lines_gone") == 0) | F.col("text").rlike(r"[^\s!-/:-@\[-`{-~]")
    n_chars = F.when(F.col("lines_gone") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return out.where(whole).withColumn("n_chars", n_chars).select(COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id."""
    return minhash.without_near_duplicates(docs.select(COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a segment of a benchmark item go."""
    return decontam.without_leaks(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens, with the pieces' ids."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), keep_ids=True)


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

#: The stages learn models and link texts by hashes: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
