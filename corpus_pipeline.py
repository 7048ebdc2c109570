"""A corpus pipeline of five stages over ``documents``: each works on all rows that the one before kept.

Quality classifier, line deduplication, near-duplicate join, benchmark decontamination, packing. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import decontam, jaccard, line_dedup, packing, quality_cnn
from leafmill.llm.common import Scratch, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on labels outside the held-out third, doesn't reject."""
    return quality_cnn.accepted(docs, quality_cnn.train(docs, table(spark, sf_dir, "labels")))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand, exactly or nearly, before them in the corpus. A document of which nothing is left goes; one that had no
    words before stays as it is."""
    cut = line_dedup.dedup(docs)
    cut = cut.where((F.col("n_dropped_lines") == 0) | F.coalesce(F.col("text").rlike(r"\S"), F.lit(True))).select(docs.columns)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id. Rows without an id stay."""
    groups = jaccard.link(docs)
    return docs.join(groups.where("doc_id <> component_id").select("doc_id"), "doc_id", "left_anti").select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", good_quality),
    ("line_dedup", distinct_lines),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: The learned classifier can't be stated in SQL; tests/llm/test_pipeline.py holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each one's rows written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        new = scratch.save(stage(spark, docs, sf_dir), name)
        scratch.drop(docs)
        docs = new
    return docs
