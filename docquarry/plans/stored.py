"""What is built of the driver's tables once a session and table, and read by every query after: indexes and stores."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docquarry.operators.inverted import InvertedIndex
from docquarry.operators.vectors import VectorIndex
from docquarry.plans import views
from docquarry.plans.shared_folder import shared_folder
from docquarry.streaming.ingest import Store

_BUILT: dict[tuple, InvertedIndex | VectorIndex | Store] = {}


def _print(spark: SparkSession, path: str) -> tuple:
    """What tells a table from another or from a later one: its files with their sizes and times."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((str(s.getPath()), s.getLen(), s.getModificationTime()) for s in store.listStatus(own)))


def documents_index(spark: SparkSession, sf_dir: str) -> InvertedIndex:
    """The inverted index of ``documents``, in the shared folder."""
    key = (spark.sparkContext.applicationId, *_print(spark, f"{sf_dir}/documents.parquet"))
    if key not in _BUILT:
        index = InvertedIndex(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
        index.add(views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
        _BUILT[key] = index
    return _BUILT[key]


def vectors_index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """The index of the vectors of ``embeddings``, in the shared folder."""
    key = (spark.sparkContext.applicationId, *_print(spark, f"{sf_dir}/embeddings.parquet"))
    if key not in _BUILT:
        index = VectorIndex(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
        index.add(views.points(spark, sf_dir).select("id", "embedding"))
        _BUILT[key] = index
    return _BUILT[key]


def ingested_documents(spark: SparkSession, sf_dir: str, build: Callable[[], Store]) -> Store:
    """The store that ``build`` makes of ``documents``, unless it is there already."""
    key = ("store", spark.sparkContext.applicationId, *_print(spark, f"{sf_dir}/documents.parquet"))
    if key not in _BUILT or _BUILT[key].log.manifest() is None:
        _BUILT[key] = build()
    return _BUILT[key]
