"""A training corpus from the documents table: language ID, quality, line dedup, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again for the next
one. All but the last keep the columns of documents. Learning uses the rows of the stage's own input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from evitrust.llm import bin_completion, language_id, line_crf, signature_tree, winnow_lines
from evitrust.llm.queries import remainder
from evitrust.llm.storage import written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose text is no farther from a known language than its calibrated limit."""
    model = language_id.train(docs, remainder(4) != 2)
    return language_id.predict(docs, model, columns=True).where("NOT rejected").select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model predicts good."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = line_crf.train(docs, labels, remainder(5) != 0)
    return line_crf.predict(docs, model, columns=True).where("predicted = 1").select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the later runs of lines of 50 words or more that stand twice; n_chars follows the text."""
    done = winnow_lines.dedup_lines(docs, every_place=True)
    return done.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each component of similar documents, and all texts without words."""
    found = signature_tree.similar_documents(docs)
    stay = found.where("component_id <=> doc_id").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(stay, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return bin_completion.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)


STAGES = [("language_id", known_language), ("quality_classifier", good_quality), ("line_dedup", without_repeated_lines),
          ("near_duplicates", without_near_copies), ("packing", packed)]

#: Models, winnowing and the packing search have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
