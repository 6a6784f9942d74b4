"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a frame, written as Parquet and read again as the next one's docs. All but the last
return the columns of documents; what a stage drops is gone for the later ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meadow.functions.shared import staged
from meadow.llm import lines, mixing, neardup, packing, quality
from meadow.llm.common import fresh, read


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; every label may teach it."""
    model = quality.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return docs.where(quality.score_column(model, F.col("text")) >= 0.5)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines leave their documents; n_chars follows. Documents that had a text and have none left go."""
    (removed,) = fresh(docs.columns, "removed")
    out = lines.without_repeated_lines(docs, count=removed)
    left = out.where((F.col(removed) == 0) | (F.length(F.trim("text")) > 0))
    chars = F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", chars).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return neardup.without_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return packing.packed(packing.pieces(docs))


STAGES = [("quality", quality_filter), ("lines", line_dedup), ("near", near_dedup), ("mix", mix), ("pack", pack)]
#: The classifier and the packing can't be said in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
