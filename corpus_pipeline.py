"""The corpus pipeline over documents: quality rules, line dedup, near duplicates, mixing, encoding.

Each stage reads what its predecessor has kept, as a table, and all but the last return the columns of
documents. Edge cases are those of the operators; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonwave.llm import op02_piece_encoding, op04_fragment_join, op05_pivotal_mix, op09_line_frequency, op10_line_dedup
from axonwave.llm.common import forget, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines above the limits."""
    return op09_line_frequency.accepted(docs, cfg=op09_line_frequency.LIMITS).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


#: A document that loses four fifths of its words to lines of others is a near copy; what is left of it is none.
NEAR_COPIES = op10_line_dedup.LinePlan(most_lost=0.8)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; those that lose four fifths of their words go."""
    return op10_line_dedup.deduped(docs, NEAR_COPIES)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id."""
    return op04_fragment_join.one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (rows repeat); documents that it does not take go."""
    return op05_pivotal_mix.mix_of(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids of each text."""
    model = op02_piece_encoding.PieceModel.load(op02_piece_encoding.model_path())
    return op02_piece_encoding.encoded(docs, model, keep_ids=True).drop("decoded")


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", mixing),
    ("piece encoding", encoding),
]

#: Random rounding and encoding are not for SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
