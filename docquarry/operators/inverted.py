"""A stored inverted index: postings by buckets of tokens, kept up to date as documents come, change and go.

Four upserted tables: postings in buckets of the token, documents (id, dl,
tokens, tf) that tell which postings a changed document had, the vocabulary
(token, df), and the totals. Questions read the buckets of their tokens and the
vocabulary, never a text.

Postings lie and move in blocks: a token with a run of variable-length whole
numbers, three for each document that has it (steps between sorted ids, twice
the tf, dl). A tf of 0 says that the document has it no more; what is added to
twice the tf is 1 where the document had the token before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators import search
from docquarry.sources.upserts import Manifest, UpsertTable

#: Buckets of tokens or ids, and tasks that write one.
BUCKETS, FILES = 32, 2
#: Postings that blocks are made of at once, and rows of a batch of blocks.
BLOCK, ROWS = 1 << 20, 1 << 14
#: Blocks that are packed at once for a shuffle.
BUNDLE = 200_000
#: Ids of changed documents that are sent to all tasks.
BROADCAST_IDS = 2_000_000
#: Documents whose postings a task scores.
SLICE = 20_000


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query go when it ends, and not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, dl, counted) of (id, words)."""
    for batch in batches:
        sizes = batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        words = batch.column(1).flatten().dictionary_encode()
        text = np.repeat(np.arange(len(sizes)), sizes)
        pairs, tf = np.unique(text * len(words.dictionary) + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
        text, token = np.divmod(pairs, max(1, len(words.dictionary)))
        counted = pa.MapArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(sizes) + 1)), pa.int32()), words.dictionary.take(pa.array(token)), pa.array(tf, pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), counted], names=["id", "dl", "counted"])


def _encoded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned numbers by seven bits a byte, the low ones first, a high bit on all but the last; and how many bytes each takes."""
    sizes = np.ones(len(values), np.int64)
    for k in range(1, 10):
        sizes += values >= np.uint64(1 << 7 * k)
    data, starts = np.empty(sizes.sum(), np.uint8), np.cumsum(sizes) - sizes
    some = np.arange(len(values))
    for k in range(int(sizes.max(initial=0))):
        some = some[sizes[some] > k]
        data[starts[some] + k] = (values[some] >> np.uint64(7 * k)).astype(np.uint8) & 127 | (sizes[some] > k + 1) * np.uint8(128)
    return data, sizes


def _decoded(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers, and where each ends."""
    ends = np.flatnonzero(data < 128) + 1
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    values, some = np.zeros(len(ends), np.uint64), np.arange(len(ends))
    for k in range(int((ends - starts).max(initial=0))):
        some = some[ends[some] - starts[some] > k]
        values[some] |= (data[starts[some] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    return values, ends


def _packed(group: np.ndarray, ids: np.ndarray, marked: np.ndarray, dl: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A block for each group, and where its first posting is; postings are in the order of groups and ids. marked: twice the tf, with what is added."""
    first = np.flatnonzero(np.diff(group, prepend=-1))
    steps = np.diff(ids, prepend=0)
    steps[first] = ids[first] << 1 ^ ids[first] >> 63  # the first id itself, small if it is near 0
    data, sizes = _encoded(np.stack([steps.view(np.uint64), marked.astype(np.uint64), dl.astype(np.uint64)], axis=1).ravel())
    offsets = np.concatenate([[0], np.cumsum(sizes)])[np.append(first, len(group)) * 3]
    return first, pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())


def _unpacked(blocks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(block, id, marked, dl) of all postings."""
    offsets = np.concatenate([[0], np.cumsum(pc.binary_length(blocks).to_numpy(zero_copy_only=False))])
    values, ends = _decoded(np.frombuffer(b"".join(blocks.to_pylist()), np.uint8))
    starts = np.searchsorted(ends, offsets, "right")[:-1] // 3
    steps, marked, dl = values.reshape(-1, 3).T
    many = np.diff(np.append(starts, len(steps)))
    steps = steps.copy()
    steps[starts] = steps[starts] >> np.uint64(1) ^ np.uint64(0) - (steps[starts] & np.uint64(1))
    sums = np.cumsum(steps)  # they wrap, and so do their differences
    ids = sums - np.repeat(sums[starts] - steps[starts], many)
    return np.repeat(np.arange(len(many)), many), ids.view(np.int64), marked.astype(np.int64), dl.astype(np.int64)


def _gathered(batches: Iterator[pa.RecordBatch], size: Callable[[pa.RecordBatch], int], most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together up to about such a size."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += size(batch)
        if n >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, block) of documents (id, dl, now, tf, before): tokens that they have now, how often, and those that they had, each by blanks."""
    for batch in _gathered(batches, lambda b: (b.column(2).nbytes + b.column(4).nbytes) // 8, BLOCK):
        batch = batch.sort_by("id")
        n, (now, tf, old) = batch.num_rows, (pc.split_pattern(batch.column(i), " ") for i in (2, 3, 4))
        words = pa.concat_arrays([now.flatten(), old.flatten()]).dictionary_encode()
        text = np.concatenate([np.repeat(np.arange(n), x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) for x in (now, old)])
        pairs, old = np.split(words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + text, [len(now.flatten())])
        marked = 2 * tf.flatten().cast(pa.int64()).to_numpy() + np.isin(pairs, old)
        lost = np.setdiff1d(old, pairs)
        pairs, marked = np.concatenate([pairs, lost]), np.concatenate([marked, np.ones(len(lost), np.int64)])
        if not len(pairs):
            continue
        order = np.argsort(pairs)
        token, text = np.divmod(pairs[order], n)
        first, blocks = _packed(token, batch.column(0).to_numpy()[text], marked[order], batch.column(1).to_numpy(zero_copy_only=False)[text])
        for at in range(0, len(first), ROWS):
            yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(token[first[at : at + ROWS]])), blocks[at : at + ROWS]], names=["token", "block"])


def _bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, bundle) of (part, token, block, __seq): the rows of a part together, packed, as a row of each for a block would be shuffled at several times its size."""
    for batch in _gathered(batches, lambda b: b.num_rows, BUNDLE):
        batch = batch.sort_by([("part", "ascending"), ("token", "ascending")])
        part = batch.column(0).to_numpy()
        starts, bundles = np.flatnonzero(np.diff(part, prepend=-1)), []
        for first, end in zip(starts, np.append(starts, len(part))[1:], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, (own := batch.slice(first, end - first).select([1, 2, 3])).schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_batch(own)
            bundles.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(part[starts]), pa.array(bundles, pa.binary())], names=["part", "bundle"])


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of bundles."""
    for batch in batches:
        for bundle in batch.column(1):
            yield from pa.ipc.open_stream(bundle.as_buffer())


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, id, tf, dl) of (token, block)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            block, ids, marked, dl = _unpacked(part.column(1))
            has = marked > 1
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(block[has])), *map(pa.array, (ids[has], marked[has] >> 1, dl[has]))], names=["token", "id", "tf", "dl"])


def _slicer(slices: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(slice, token, block) of (token, block): postings by the remainder of their ids."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                block, ids, marked, dl = _unpacked(part.column(1))
                has = marked > 1
                block, ids, marked, dl = block[has], ids[has], marked[has], dl[has]
                if not len(ids):
                    continue
                group = ids % slices * part.num_rows + block
                order = np.argsort(group, kind="stable")
                first, blocks = _packed(group[order], ids[order], marked[order], dl[order])
                own, row = np.divmod(group[order][first], part.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), part.column(0).take(pa.array(row)), blocks], names=["slice", "token", "block"])

    return sliced


def _scorer(asked: search.Asked, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(query_id, id, score): the best of each query out of blocks (slice, token, block) that hold all asked postings of their documents."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, best = [], search.Best(asked, k)
        for batch in batches:
            code = asked.codes(batch.column(1))
            has = code >= 0
            block, *posting = _unpacked(batch.column(2).filter(pa.array(has)))
            held.append(np.stack([*posting, code[has][block]]))
        ids, marked, dl, token = np.concatenate(held, axis=1) if held else np.zeros((4, 0), np.int64)
        order = np.argsort(ids, kind="stable")
        own, text = np.unique(ids[order], return_inverse=True)
        ends = np.searchsorted(text, np.arange(0, len(own) + search.SCAN_TEXTS, search.SCAN_TEXTS))
        for at, first, end in zip(range(0, len(own), search.SCAN_TEXTS), ends, ends[1:], strict=False):
            some, texts = order[first:end], own[at : at + search.SCAN_TEXTS]
            best.take(texts, *asked.scores(len(texts), text[first:end] - at, token[some], marked[some] >> 1, dl[some]))
        yield pa.RecordBatch.from_arrays([*map(pa.array, best.rows())], names=["query_id", "id", "score"])

    return scored


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, d) of (token, block): by how many documents more have the token than before."""
    for batch in batches:
        block, _, marked, _ = _unpacked(batch.column(1))
        d = np.bincount(block, 1 - (marked & 1) - (marked < 2), batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(d.astype(np.int64))], names=["token", "d"])


def _by_token(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of tokens as batches that hold all rows of each of their tokens."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            token = batch.column(0)
            start = pc.index(pc.equal(token, token[-1]), True).as_py()  # the last token may go on
            if held and held[-1].column(0)[-1].as_py() == token[-1].as_py():
                start = 0
            if start or held and held[-1].column(0)[-1].as_py() != token[0].as_py():
                yield pa.Table.from_batches([*held, batch.slice(0, start)]).combine_chunks().to_batches()[0]
                held = []
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _merger(whole: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One block for each token out of (token, block, __seq, __bucket) in the order of tokens: the newest posting of a document counts. whole: buckets where those that it has no more go."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_token(batches):
            block, ids, marked, dl = _unpacked(batch.column(1))
            seq, bucket = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            tokens = batch.column(0).dictionary_encode()
            token = tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.lexsort((seq[block], ids, token[block]))
            block, ids, marked, dl = (x[order] for x in (block, ids, marked >> 1 << 1, dl))
            last = np.append((np.diff(token[block]) != 0) | (np.diff(ids) != 0), True)
            keep = last & ((marked > 0) | ~np.isin(bucket[block], whole))
            block, ids, marked, dl = (x[keep] for x in (block, ids, marked, dl))
            if not len(block):
                continue
            first, blocks = _packed(token[block], ids, marked, dl)
            newest = np.zeros(len(tokens.dictionary), np.int64)
            np.maximum.at(newest, token, seq)
            own = block[first]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), blocks, pa.array(newest[token[own]]), pa.array(np.zeros(len(own), bool)), pa.array(bucket[own], pa.int32())], names=["token", "block", "__seq", "__deleted", "__bucket"])

    return merged


class Postings(UpsertTable):
    """A table of blocks that reads as postings (token, id, tf, dl)."""

    def read(self, version: int | None = None, only: set[int] | None = None, tokens: DataFrame | None = None) -> DataFrame | None:
        """Those of a version, or of the newest, perhaps of some buckets or of these tokens (token) only; null for a table without any."""
        found = self.blocks(only, tokens, version)
        return None if found is None else found.mapInArrow(_postings, "token string, id long, tf long, dl long")

    def blocks(self, only: set[int] | None = None, tokens: DataFrame | None = None, version: int | None = None) -> DataFrame | None:
        """(token, block), the newest posting of a document only; there may be several blocks of a token."""
        own = self.manifest(version)
        if own is None:
            return None
        sets = [[f for f, _, _ in entries] for bucket, entries in own.sets.items() if only is None or bucket in only]
        plain, mixed = ([f for x in sets if (len(x) > 1) == many for f in x] for many in (False, True))
        plain, mixed = (x if tokens is None else x.join(tokens, "token", "left_semi") for x in (self._load(own, plain), self._load(own, mixed)))
        newest = self._merged(mixed.withColumn("__bucket", self._bucket(own)).repartition("token"), list(own.sets))
        return plain.select("token", "block").unionByName(newest.select("token", "block"))

    def _dealt(self, rows: DataFrame, own: Manifest) -> DataFrame:
        part = self._bucket(own) * self.files + F.pmod(F.hash("token"), F.lit(self.files))
        bundles = rows.select(part.alias("part"), "token", "block", "__seq").mapInArrow(_bundled, "part int, bundle binary").repartition(own.buckets * self.files, "part")
        return bundles.mapInArrow(_opened, "token string, block binary, __seq long").select("*", F.lit(False).alias("__deleted"), self._bucket(own).alias("__bucket"))

    def _merged(self, rows: DataFrame, whole: list[int]) -> DataFrame:
        ordered = rows.select("token", "block", "__seq", "__bucket").sortWithinPartitions("__bucket", "token")
        return ordered.mapInArrow(_merger(whole), "token string, block binary, __seq long, __deleted boolean, __bucket int")


class InvertedIndex:
    """An index under ``path``; its ids are whole numbers."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, files: int = FILES, keep: int = 1):
        """keep: versions that an addition leaves; a question that was planned before it reads its own."""
        self.spark, self.path, self.keep = spark, path, keep
        self.postings = Postings(spark, f"{path}/postings", ["token"], groups=True, buckets=buckets, files=files, codec="zstd")
        self.documents = UpsertTable(spark, f"{path}/documents", ["id"], buckets=buckets, files=files, codec="zstd")
        self.vocabulary = UpsertTable(spark, f"{path}/vocabulary", ["token"], buckets=buckets, codec="zstd")
        self.totals = UpsertTable(spark, f"{path}/totals", ["name"], buckets=1)

    def add(self, docs: DataFrame, gone: DataFrame | None = None, batch: int | None = None) -> None:
        """Take documents (id, text) in, in the place of those of the same id, and those of ``gone`` (id) out.

        Of several texts of one id the greatest counts. Batches count up from 0;
        one that comes again changes nothing, and one that was lost goes on with
        the first table that lacks it, out of what the table before it has of it.
        Null texts have no tokens; a null id is left out.
        """
        done = self.totals.manifest()
        batch = (done.writers["add"] + 1 if done else 0) if batch is None else batch
        if done and done.writers["add"] >= batch:
            return
        if (old := self.postings.manifest()) and "block" not in old.schema.names:
            raise ValueError(f"{self.path} has postings of an older form: make the index anew")
        mine = {"writer": "add", "batch": batch}
        lacks = lambda table: table.before("add", batch) == next(iter(reversed(table.versions())), None)
        with shuffles_dropped(self.spark):
            if lacks(self.documents):
                lists = {"tokens": F.map_keys("counted"), "tf": F.map_values("counted").cast("array<string>")}
                words = self._words(docs).select("id", "dl", *(F.when(F.size("counted") > 0, F.array_join(x, " ")).alias(name) for name, x in lists.items()))
                out = None if gone is None else gone.select(F.col("id").cast("long").alias("id")).join(docs.select(F.col("id").cast("long").alias("id")), "id", "left_anti")
                self.documents.commit(words, out, distinct=True, dealt=True, merge=False, **mine)
            if lacks(self.postings):
                self.postings.commit(self._changed(batch).mapInArrow(_blocks, "token string, block binary"), **mine)
            if lacks(self.vocabulary):
                change = self.postings.batch("add", batch).select("token", "block").mapInArrow(_changes, "token string, d long").groupBy("token").agg(F.sum("d").alias("df"))
                if (known := self.vocabulary.read()) is not None:
                    change = change.where("df <> 0").join(known.withColumnRenamed("df", "had"), "token", "left").select("token", (F.coalesce("had", F.lit(0)) + F.col("df")).alias("df"))
                self.vocabulary.commit(change, F.col("df") <= 0, distinct=True, **mine)
            self.postings.expire(self.keep)
            self.documents.merge()  # not before old postings are gone: disk holds what one table merges at a time
            self.documents.expire(self.keep)
            own = self.documents.read().agg(F.lit("corpus").alias("name"), F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl"))
            self.totals.commit(own, **mine)
            self.vocabulary.expire(self.keep)
            self.totals.expire(self.keep)

    def _words(self, docs: DataFrame) -> DataFrame:
        """(id, dl, counted): tokens of each document with how often it has them. One shuffle, by bucket and id; tokens are counted where a text lies, a batch of texts at once; a document without tokens stays."""
        own, by = self.documents.by_bucket(docs.where("id is not null").select(F.col("id").cast("long").alias("id"), "text"))
        return own.groupBy(*by, "id").agg(F.max("text").alias("text")).select("id", search.tokens(F.col("text")).alias("words")).mapInArrow(_counted, "id long, dl long, counted map<string,long>")

    def _changed(self, batch: int) -> DataFrame:
        """(id, dl, now, tf, before) of the documents of a batch."""
        none = F.lit(None).cast("string")
        new, version = self.documents.batch("add", batch), self.documents.before("add", batch)
        own = new.select("id", F.coalesce("dl", F.lit(0)).alias("dl"), F.col("tokens").alias("now"), "tf")
        if version is None:
            return own.withColumn("before", none)
        # of the documents that were there before only those that change are read with their tokens
        known = self.documents.read(version).select("id").join(new.select("id"), "id", "left_semi")
        many = known.count()
        if not many:
            return own.withColumn("before", none)
        old = self.documents.read(version).join(F.broadcast(known) if many <= BROADCAST_IDS else known, "id", "left_semi").select("id", F.col("tokens").alias("before"))
        return own.join(old, "id", "left")

    def wanted(self, terms: DataFrame) -> DataFrame:
        """(id, token, tf, dl) of the tokens of ``terms`` (query_id, token, qtf), from their buckets only."""
        tokens = terms.select("token").distinct()
        return self.postings.read(only=self.postings.buckets_of(tokens), tokens=tokens)

    def stats(self) -> DataFrame:
        """(token, df, dl) as ``search.corpus_stats`` gives them."""
        totals = self.totals.read().select(F.lit(None).cast("string").alias("token"), F.col("n").alias("df"), "dl")
        return totals.unionByName(self.vocabulary.read().select("token", "df", F.lit(0).cast("long").alias("dl")))

    def bm25(self, terms: DataFrame, k: int) -> DataFrame:
        """(query_id, id, score, rank). Postings of the terms go by slices of ids as blocks, each once whatever the number of its queries; a task scores a slice and hands on the best."""
        n = self.totals.read().first()["n"]
        slices = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-n // SLICE))
        tokens = terms.select("token").distinct()
        blocks = self.postings.blocks(self.postings.buckets_of(tokens), tokens)
        dealt = blocks.mapInArrow(_slicer(slices), "slice int, token string, block binary").repartition(slices, "slice")
        found = [dealt.mapInArrow(_scorer(search.Asked(part), k), "query_id long, id long, score double") for part in search.asked_blocks(terms, self.stats())]
        return search.top_of(reduce(DataFrame.unionByName, found), k)

    def keyword(self, terms: DataFrame, k: int) -> DataFrame:
        return search.keyword_topk(self.wanted(terms), terms, k)
