"""From raw documents to packed sequences: quality rules, quality classifier, line dedup, near-duplicate removal, packing.

Each stage's result is written as Parquet to a folder below the session's shared one and read again as the next stage's input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.llm import dart_minhash, line_dedup, packing, quality_classifier, quality_rules
from placewright.llm.common import documents, new_folder, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules keep."""
    return quality_rules.kept(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. It learns from the labelled rows of the raw table, which still has both labels."""
    model = quality_classifier.fitted(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return quality_classifier.scored(docs, model).where(F.col("_score") >= quality_classifier.THRESHOLD).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that others share; ``n_chars`` follows the text."""
    left = line_dedup.without_shared_lines(docs)
    return left.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return dart_minhash.one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences that hold all documents that are left."""
    return packing.packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", rules), ("quality_classifier", classifier), ("line_dedup", lines), ("near_dedup", near_duplicates), ("packing", packed),
]

#: The classifier's training can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs, folder = documents(spark, sf_dir), new_folder(spark, "pipeline")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs
