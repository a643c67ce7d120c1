"""Corpus pipeline: quality rules, toxicity, near-duplicates, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.llm import near_dups, packing, quality, shared, toxicity
from docquarry.llm.queries import BPE_JSON, PATTERN

#: Words in a shingle of the near-duplicate stage.
SHINGLE_WORDS = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the references of their languages accept; null texts go, repeated rows and null ids stay or go as any others."""
    return quality.accepted(docs, quality.references(docs))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under the threshold, by a machine fitted on labelled rows of ``docs``; without labels of both kinds all are alike. Null and empty texts have the score of no terms."""
    return toxicity.accepted(docs, toxicity.train(docs, shared.table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near-duplicates.

    Rows with one doc_id are one document, of which the first row in the order
    of its JSON stays. Rows without an id cannot be named in a group and stay.
    Columns may have any names and types.
    """
    own, at = shared.new_name(docs, "id"), shared.new_name(docs, "row")
    kept = near_dups.near_duplicates(docs, SHINGLE_WORDS).where("kept and doc_id is not null").select(F.col("doc_id").alias(own)).distinct()
    order = Window.partitionBy("doc_id").orderBy(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))
    first = docs.where("doc_id is not null").join(kept, F.col("doc_id") == F.col(own), "left_semi").withColumn(at, F.row_number().over(order)).where(F.col(at) == 1).drop(at)
    return first.unionByName(docs.where("doc_id is null"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of op1_best_fit_packing for the documents that are left; other columns than doc_id and text are not read. Null and empty texts are one end token."""
    return packing.pack(packing.token_pieces(docs, BPE_JSON, PATTERN))


STAGES = [("quality_rules", quality_rules), ("toxicity", toxicity_filter), ("near_dedup", near_dedup), ("best_fit_packing", best_fit_packing)]

#: SQL cannot express the stages; tests/llm/test_pipeline.py compares them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one returns is written in the shared folder and read by the next."""
    folder = f"{shared.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
