"""Readers and writers: prepared nodes, files to ingest, QA sets and artifacts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.functions import text

#: One schema for nodes of every kind; fields of one kind are null for the others.
NODES = T.StructType([T.StructField(n, t) for n, t in (
    ("doc_id", T.StringType()), ("page", T.StringType()), ("type", T.StringType()), ("text", T.StringType()), ("table_id", T.StringType()), ("row_idx", T.LongType()),
    ("column_idx", T.LongType()), ("column_name", T.StringType()), ("note_idx", T.LongType()), ("metadata", T.MapType(T.StringType(), T.StringType())),
)])
QA = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "question", "answer", "doc_id")])
MOST_FILES, MOST_BYTES, SUFFIXES = 10, 50 * 1024 * 1024, ("pdf",)


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Prepared nodes as JSON lists; a page that is no number becomes null."""
    rows = spark.read.schema(NODES).option("multiLine", True).json(path)
    return rows.withColumn("page", F.when(F.col("page").rlike("^[0-9]+$"), F.col("page")).cast("int"))


def write_artifacts(nodes: DataFrame, path: str) -> None:
    """Nodes as Parquet by document; documents that are not among them stay as they are."""
    nodes.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").parquet(path)


def read_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, doc_id, length, content) of files by a glob."""
    rows = spark.read.format("binaryFile").load(pattern)
    return rows.select("path", text.doc_id_of_file(F.col("path")).alias("doc_id"), "length", "content")


def accepted_files(files: DataFrame) -> DataFrame:
    """Files with a verdict: extension, size and number of an upload (path, length)."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1))
    few = files.agg(F.count("*") <= MOST_FILES).scalar()
    said = F.when(~suffix.isin(*SUFFIXES), "type").when(F.col("length") > MOST_BYTES, "size").when(~few, "count").otherwise("ok")
    return files.select("path", "length", said.alias("verdict"))


def extract_pages(files: DataFrame, extractor: Callable[[bytes], list[str]]) -> DataFrame:
    """(doc_id, page, text) by a function from a file's bytes to its pages; there is no built-in reader of PDF."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(d, p, t) for d, content in zip(pdf["doc_id"], pdf["content"]) for p, t in enumerate(extractor(content), 1)], columns=["doc_id", "page", "text"])

    return files.select("doc_id", "content").mapInPandas(run, "doc_id string, page int, text string")


def plain_pages(content: bytes) -> list[str]:
    """Pages of a text file, which form feeds separate."""
    return content.decode("utf-8", "replace").split("\f")


def strict_pages(content: bytes) -> list[str]:
    """Pages of a text file that must be UTF-8."""
    return content.decode("utf-8").split("\f")


def read_qa(spark: SparkSession, path: str) -> DataFrame:
    """Pairs with both sides, as training rows of weight 0.9."""
    rows = spark.read.schema(QA).option("multiLine", True).json(path)
    both = (F.trim(F.coalesce("question", F.lit(""))) != "") & (F.trim(F.coalesce("answer", F.lit(""))) != "")
    return rows.where(both).select(F.col("question").alias("text1"), F.col("answer").alias("text2"), F.lit(0.9).alias("label"))


def write_qa(pairs: DataFrame, path: str) -> None:
    """Pairs as JSON, with an id from their content where there is none."""
    made = F.sha2(F.concat_ws("|", "doc_id", "question", "answer"), 256)
    pairs.withColumn("id", F.coalesce("id", F.substring(made, 1, 32))).write.mode("overwrite").json(path)


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)
