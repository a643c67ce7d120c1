"""Ingest of files as a stream: pages, chunks with vectors and edges of the files that can be read, the others apart.

A batch of files is read once and staged; every table then takes its rows by a
commit of its own that a repeated batch does not make again. So a run that is
lost goes on with the tables that had not yet taken the batch, and a file that
fails, or a chunk that the model refuses, fails alone. Tables that do not wait
for each other take a batch at the same time; the log, which ends it, is last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.functions import slots, text
from docquarry.operators import graph
from docquarry.plans import service
from docquarry.sources import files
from docquarry.sources.upserts import Folder, UpsertTable

#: Tries of a file; files of a batch.
TRIES, FILES_EACH = 3, 1000
#: What happened to a file: read, not read, or read from another path of the same document in the same batch.
OK, FAILED, REPLACED = "ok", "failed", "replaced"
_FILES = "path string, modificationTime timestamp, length long, content binary"
_STAGED = "path string, doc_id string, length long, page int, text string, error string"
_ARROW = pa.schema([("path", pa.string()), ("doc_id", pa.string()), ("length", pa.int64()), ("page", pa.int32()), ("text", pa.string()), ("error", pa.string())])
#: Characters of pages that a worker hands on at once, or those of one file.
_HANDED = 4_000_000
#: Tasks that list files and folders; without a bound each folder is a task of its own.
_LISTING = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": "64"}


@dataclass(frozen=True)
class Store:
    """The tables of a collection under a path."""

    spark: SparkSession
    path: str

    def _table(self, name: str, key: list[str], groups: bool) -> UpsertTable:
        return UpsertTable(self.spark, f"{self.path}/{name}", key, groups=groups)

    @property
    def pages(self) -> UpsertTable:
        """(doc_id, page, text): all pages of a document come from one file."""
        return self._table("pages", ["doc_id"], True)

    @property
    def points(self) -> UpsertTable:
        """Chunks with their vectors."""
        return self._table("points", ["doc_id"], True)

    @property
    def edges(self) -> UpsertTable:
        """(src, rel, dst, doc_id, corpus_id): documents to chunks, and what texts say of names."""
        return self._table("edges", ["doc_id"], True)

    @property
    def log(self) -> UpsertTable:
        """(writer, batch, path, doc_id, length, status, pages, chunks, refused, error): what each batch did with each file."""
        return self._table("log", ["writer", "batch", "path"], False)

    @property
    def dead_letters(self) -> UpsertTable:
        """(path, doc_id, length, error) of files that could not be read, until another file of their document can."""
        return self._table("dead_letters", ["path"], False)

    def tables(self) -> dict[str, UpsertTable]:
        return {"pages": self.pages, "points": self.points, "edges": self.edges, "log": self.log, "dead_letters": self.dead_letters}

    def delete(self, gone: DataFrame) -> None:
        """Take documents (doc_id) out of every table. A table that lost them before stays as it is, so a lost run can be repeated."""
        for table in self.tables().values():
            if (rows := table.read()) is not None:
                keys = rows.join(gone.select("doc_id").distinct(), "doc_id", "left_semi").select(*table.key).distinct()
                if not keys.isEmpty():
                    table.commit(None, keys)

    def reset(self) -> None:
        """Empty every table; what they held before stays in their earlier versions until these expire."""
        for table in self.tables().values():
            if (rows := table.read()) is not None and not rows.isEmpty():
                table.commit(None, rows)


def extracted(batch: DataFrame, extractor: Callable[[bytes], list[str]], doc_id: Column, most_bytes: int = files.MOST_BYTES, tries: int = TRIES) -> DataFrame:
    """A row for each page of files (path, length, content), or one with the error of a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            size = 0
            for row in range(batch.num_rows):
                path, name, length, content = (c[row].as_py() for c in batch.columns)
                pages, error = None, f"larger than {most_bytes} bytes"
                if length <= most_bytes:
                    ((pages, error),) = slots.salvaged(lambda x: [extractor(x[0])], [content], tries)
                found = [(path, name, length, n, t, None) for n, t in enumerate(pages or [], 1) if t.strip()]
                held += found or [(path, name, length, None, None, error or "no text")]
                size += sum(len(f[4]) for f in found)
                if size >= _HANDED or row == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _ARROW.types)], schema=_ARROW)
                    held, size = [], 0

    own = batch.select("path", doc_id.alias("doc_id"), "length", F.when(F.col("length") <= most_bytes, F.col("content")).alias("content"))
    return own.mapInArrow(run, _STAGED)


def ingest_batch(store: Store, batch: DataFrame, number: int, extractor: Callable[[bytes], list[str]], writer: str, doc_id: Column, corpus: str | None = None) -> None:
    """Take one batch of files into the tables of a store.

    Of several files of one document in a batch the greatest path counts. A
    document whose file fails keeps what it had.
    """
    spark, staging = store.spark, f"staging/{writer}-{number:010d}"
    folder = Folder(spark, store.path)
    if store.log.read() is not None and store.log.manifest().writers.get(writer, -1) >= number:
        return
    if not folder.exists(f"{staging}/pages/_SUCCESS"):
        extracted(batch, extractor, doc_id).write.mode("overwrite").parquet(f"{store.path}/{staging}/pages")
    rows = spark.read.parquet(f"{store.path}/{staging}/pages")
    if not folder.exists(f"{staging}/files/_SUCCESS"):
        seen = rows.groupBy("path", "doc_id").agg(F.max("length").alias("length"), F.count("page").alias("pages"), F.first("error").alias("error"))
        newest = F.row_number().over(Window.partitionBy("doc_id", F.col("pages") > 0).orderBy(F.desc("path")))
        seen.withColumn("at", F.when(F.col("pages") > 0, newest)).write.mode("overwrite").parquet(f"{store.path}/{staging}/files")
    seen = spark.read.parquet(f"{store.path}/{staging}/files")
    read, failed = seen.where("at is not null"), seen.where("at is null").select("path", "doc_id", "length", "error")
    # the paths of a batch are as few as its files
    pages = rows.join(F.broadcast(seen.where("at = 1").select("path")), "path", "left_semi").select("doc_id", "page", "text")

    def stage_points() -> None:
        if not folder.exists(f"{staging}/points/_SUCCESS"):
            made = slots.called(service.build_chunks(pages), "embed", "text", "array<float>", "embedding", "refusal", lambda v: [float(x) for x in v])
            made = slots.called(made, "triples", "text", "array<struct<src:string,rel:string,dst:string>>", "triples", "untold", lambda t: [dict(zip(("src", "rel", "dst"), x)) for x in t])
            made.withColumn("num", service.numbered_id(F.col("id"))).write.mode("overwrite").parquet(f"{store.path}/{staging}/points")

    def take_dead_letters() -> None:
        old = store.dead_letters.read()
        mended = None if old is None else old.join(read, "doc_id", "left_semi").select("path").join(failed.select("path"), "path", "left_anti")
        store.dead_letters.commit(failed, mended, writer=writer, batch=number, distinct=True)

    _together(spark, stage_points, lambda: store.pages.commit(pages, writer=writer, batch=number), take_dead_letters)
    points = spark.read.parquet(f"{store.path}/{staging}/points")
    told = points.select("doc_id", F.inline("triples"))
    named = graph.sanitized(told, "doc_id").unionByName(points.select(F.col("doc_id").alias("src"), F.lit("HAS_CHUNK").alias("rel"), F.col("id").alias("dst"), "doc_id"))
    edges = graph.stamped(named.distinct().withColumn("corpus_id", F.lit(None).cast("string")), "", corpus or writer)
    _together(
        spark,
        lambda: store.points.commit(points.where("refusal is null").drop("refusal", "triples", "untold"), writer=writer, batch=number),
        lambda: store.edges.commit(edges, writer=writer, batch=number),
    )
    counts = points.groupBy("doc_id").agg(F.count("*").alias("chunks"), (F.count("refusal") + F.count("untold")).alias("refused"))
    status = F.when(F.col("pages") == 0, FAILED).when(F.col("at") == 1, OK).otherwise(REPLACED)
    log = seen.join(counts, "doc_id", "left").withColumn("status", status)
    own = F.col("status") == OK
    log = log.select(F.lit(writer).alias("writer"), F.lit(number).cast("long").alias("batch"), "path", "doc_id", "length", "status", "pages", *(F.when(own, F.coalesce(c, F.lit(0))).alias(c) for c in ("chunks", "refused")), "error")
    store.log.commit(log, writer=writer, batch=number, distinct=True)
    folder.drop(staging)


def _together(spark: SparkSession, *steps: Callable[[], object]) -> None:
    """Run steps at the same time; when all have ended, the first error is raised."""
    with ThreadPoolExecutor(len(steps)) as pool:
        ends = [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]
    for end in ends:
        end.result()


def ingest(store: Store, pattern: str, checkpoint: str, extractor: Callable[[bytes], list[str]] = files.plain_pages, writer: str = "ingest", doc_id: Column | None = None, corpus: str | None = None, files_each: int = FILES_EACH, nested: bool = False) -> None:
    """Take every file under a folder that the checkpoint has not seen yet, ``files_each`` a batch, and stop.

    A file is known by its path: a changed one has to come under another path.
    ``doc_id`` names a file's document by its ``path``; without it the file's
    name without its ending does.
    """
    named = text.doc_id_of_file(F.col("path")) if doc_id is None else doc_id
    reader = store.spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", files_each).option("recursiveFileLookup", str(nested).lower())
    sink = lambda batch, number: ingest_batch(store, batch, number, extractor, writer, named, corpus)
    before = {name: store.spark.conf.get(name) for name in _LISTING}
    try:
        for name, value in _LISTING.items():
            store.spark.conf.set(name, value)
        reader.load(pattern).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for name, value in before.items():
            store.spark.conf.set(name, value)


def progress(store: Store) -> DataFrame:
    """(writer, batch, files, failed, pages, chunks) of each batch that is done."""
    log = store.log.read()
    return log.groupBy("writer", "batch").agg(F.count("*").alias("files"), F.count_if(F.col("status") == FAILED).alias("failed"), F.sum("pages").alias("pages"), F.sum("chunks").alias("chunks"))
