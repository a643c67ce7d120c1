"""What the operators share: tables, checkpoints and walks over Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once, if documents are shorter.
SLICE_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint in the folder that the cluster names; a temporary one only where none is named."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or else that of checkpoints; a temporary one only in local mode, as executors elsewhere do not see it."""
    context = spark.sparkContext
    if named := context.getConf().get("spark.checkpoint.dir", ""):
        return named
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="docquarry-"))
    return context._jsc.sc().getCheckpointDir().get()


def new_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, in whatever case."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in taken:
        name = "_" + name
    return name


def slices(batches: Iterator[pa.RecordBatch], text_at: int = 1, most: int = SLICE_CHARS) -> Iterator[tuple[list, ...]]:
    """Columns of the batches as lists, at most ``most`` bytes of text at a time if documents are shorter."""
    for batch in batches:
        first, size = 0, 0
        lengths = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_pylist()
        for i, n in enumerate(lengths):
            if size and size + n > most:
                yield tuple(c.slice(first, i - first).to_pylist() for c in batch.columns)
                first, size = i, 0
            size += n
        if first < len(lengths):
            yield tuple(c.slice(first).to_pylist() for c in batch.columns)


def give_back(done: Callable[[], None] | None = None) -> None:
    """At a task's end: ``done`` empties memos, and unused memory goes to the system, as the worker lives on for other stages."""
    if done:
        done()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def filter_texts(df: DataFrame, accept: Callable[..., list[bool]], others: tuple | list = (), done: Callable[[], None] | None = None) -> DataFrame:
    """The rows, with all their columns, whose text is accepted, in Python workers over Arrow.

    accept takes lists of the texts and of the other columns; done runs at the end of a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts: list[bool] = []
            for part in slices([pa.RecordBatch.from_arrays([batch.column(i) for i in at], names=names)], 0):
                verdicts += accept(*part)
            yield batch.filter(pa.array(verdicts, pa.bool_()))
        give_back(done)

    names = ["text", *others]
    at = [df.columns.index(n) for n in names]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # a name may hold a dot
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def map_texts(df: DataFrame, fn: Callable[..., Iterator[dict]], schema: str, arrow: pa.Schema, columns: list | None = None, text_at: int = 1, done: Callable[[], None] | None = None, most: int = SLICE_CHARS) -> DataFrame:
    """fn(column lists) to a dict of column lists, slice by slice, in Python workers over Arrow; done runs at the end of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_at, most):
            yield pa.RecordBatch.from_pydict(fn(*part), schema=arrow)
        give_back(done)

    picked = df.select(*(columns or [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]))
    return picked.mapInArrow(run, schema)
