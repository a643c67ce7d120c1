"""Tables that take upserts: hash buckets, a small file set for each batch, snapshots by manifest.

A batch is written beside what is there, by bucket, and each row keeps the
number of its commit; the newest commit of a key wins. In a bucket the newest
file sets are merged while the one before is at most twice as large, so that a
byte is rewritten a logarithmic number of times and what a commit writes
follows its batch. A manifest, written last and renamed into place, names the
file sets of a version: without it nothing of a commit shows. One writer at a
time.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a new table. A table keeps those that it was made with.
BUCKETS = 16
#: A file set is merged with the one before it if that is at most so many times as large.
RATIO = 2
_SEQ, _DELETED, _BUCKET, _FILE = "__seq", "__deleted", "__bucket", "__file"


class Folder:
    """Small files and listings under a path, in whatever store Spark reads it from."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._jvm = path, spark.sparkContext._jvm
        self._files = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._files.listStatus(self._at(name))) if self._files.exists(self._at(name)) else []

    def exists(self, name: str) -> bool:
        return self._files.exists(self._at(name))

    def size(self, name: str) -> int:
        return self._files.getContentSummary(self._at(name)).getLength()

    def text(self, name: str) -> str:
        stream = self._files.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Write beside and rename, so that a reader sees all of it or nothing."""
        stream = self._files.create(self._at(f"{name}.new"), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self._files.rename(self._at(f"{name}.new"), self._at(name)):
            raise OSError(f"{self.path}/{name} is there already: a table takes one writer at a time")

    def drop(self, name: str) -> None:
        self._files.delete(self._at(name), True)


@dataclass
class Manifest:
    """A version: its file sets (folder, bytes, tombstones) by bucket, oldest first, and the last batch of each writer."""

    version: int
    key: list[str]
    buckets: int
    schema: T.StructType
    sets: dict[int, list[tuple[str, int, bool]]] = field(default_factory=dict)
    writers: dict[str, int] = field(default_factory=dict)
    by: list[str] = field(default_factory=list)
    written: int = 0

    def dump(self) -> str:
        return json.dumps(self.__dict__ | {"schema": self.schema.jsonValue()})

    @staticmethod
    def load(text: str) -> Manifest:
        own = json.loads(text)
        sets = {int(b): [(f, n, d) for f, n, d in entries] for b, entries in own["sets"].items()}
        return Manifest(**own | {"schema": T.StructType.fromJson(own["schema"]), "sets": sets})


class UpsertTable:
    """A table under ``path`` with a row, or with ``groups`` all rows of one commit, for each key."""

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], order: str | None = None, groups: bool = False, buckets: int = BUCKETS, by: Sequence[str] = (), files: int = 1, codec: str = "snappy"):
        """``by``: columns of the key that tell the bucket, all without it; files: tasks that write a bucket; codec: of what is written from now on."""
        self.spark, self.path, self.key, self.order, self.groups, self.buckets = spark, path, list(key), order, groups, buckets
        self.by, self.files, self.codec = list(by) or self.key, files, codec
        self.folder = Folder(spark, path)

    def versions(self) -> list[int]:
        return [int(n[2:-5]) for n in self.folder.names("manifests") if n.startswith("v=") and n.endswith(".json")]

    def manifest(self, version: int | None = None) -> Manifest | None:
        """That of a version, or the newest; null for a table without any."""
        found = self.versions()
        if not found or version is not None and version not in found:
            return None
        return Manifest.load(self.folder.text(f"manifests/v={found[-1] if version is None else version:010d}.json"))

    def read(self, version: int | None = None, only: set[int] | None = None) -> DataFrame | None:
        """The rows of a version, or of the newest, perhaps of some buckets only; null for a table without any."""
        own = self.manifest(version)
        if own is None:
            return None
        self.key = own.key
        plain, mixed = [], []
        for bucket, entries in own.sets.items():
            if only is not None and bucket not in only:
                continue
            (plain if len(entries) == 1 and not entries[0][2] else mixed).extend(f for f, _, _ in entries)
        rows = self._newest(self._load(own, mixed)).where(~F.col(_DELETED))
        return self._load(own, plain).unionByName(rows).drop(_SEQ, _DELETED)

    def batch(self, writer: str, number: int) -> DataFrame:
        """What the newest commit took in, that batch of a writer, with ``__deleted`` for keys that went; it is there until a later version alone is kept."""
        own = self.manifest()
        if own is None or own.writers.get(writer) != number:
            raise ValueError(f"batch {number} of {writer!r} is not the newest commit")
        folder = f"data/v{own.version:010d}"
        return self._load(own, [f"{folder}/{n}" for n in self.folder.names(folder) if n.startswith(_BUCKET)])

    def before(self, writer: str, number: int) -> int | None:
        """The newest version without that batch of a writer; null where there is none."""
        return next((v for v in reversed(self.versions()) if self.manifest(v).writers.get(writer, -1) < number), None)

    def buckets_of(self, rows: DataFrame) -> set[int]:
        """The buckets that these rows lie in; at most as many as the table has."""
        own = self.manifest()
        return {r[0] for r in rows.select(self._bucket(own).alias("b")).distinct().collect()} if own else set()

    def commit(self, rows: DataFrame | None, gone: DataFrame | Column | None = None, writer: str = "", batch: int | None = None, distinct: bool = False, dealt: bool = False, merge: bool = True) -> Manifest:
        """A new version with these rows in the place of their keys' own and without the keys of ``gone``.

        A batch number of a writer that is not above its last one changes
        nothing. Of several rows of a key the one with the greatest ``order``
        counts, of equal ones the greatest by its text; with ``groups`` all do.
        A key that is both in the rows and gone stays. distinct: no two rows
        share a key, and none of them is gone; ``gone`` may then be a condition
        on the rows. dealt: the rows lie by bucket already, as ``by_bucket`` deals them.
        merge: whether file sets are merged at once, and not by ``merge`` later.
        """
        old = self.manifest()
        if old and batch is not None and old.writers.get(writer, -1) >= batch:
            return old
        if rows is None and gone is None:
            raise ValueError("neither rows nor keys")
        new = self._batch(rows, gone, old, distinct)
        version = old.version + 1 if old else 0
        names = {f.name for f in old.schema} if old else set()
        fields = [*(old.schema.fields if old else []), *(f for f in new.schema.fields if f.name not in names and f.name not in (_SEQ, _DELETED))]
        own = Manifest(version, old.key if old else self.key, old.buckets if old else self.buckets, T.StructType(fields), dict(old.sets) if old else {}, dict(old.writers) if old else {}, old.by if old else self.by)
        if own.key != self.key:
            raise ValueError(f"the table's key is {own.key}")
        new = new.withColumn(_SEQ, F.lit(version).cast("long"))
        added = self._write(new.withColumn(_BUCKET, self._bucket(own)) if dealt else self._dealt(new, own), f"data/v{version:010d}", own)
        for bucket, size in added.items():
            entries = own.sets.get(bucket, [])
            own.sets[bucket] = [*entries, (f"data/v{version:010d}/{_BUCKET}={bucket}", size, gone is not None)]
            own.written += size
        if merge:
            self._compact(own)
        if batch is not None:
            own.writers[writer] = batch
        self.folder.put(f"manifests/v={version:010d}.json", own.dump())
        return own

    def merge(self) -> None:
        """A new version with the file sets merged that a commit has left, if there are any."""
        own = self.manifest()
        own.version, sets = own.version + 1, dict(own.sets)
        self._compact(own)
        if own.sets != sets:
            self.folder.put(f"manifests/v={own.version:010d}.json", own.dump())

    def sink(self, writer: str) -> Callable[[DataFrame, int], None]:
        """For foreachBatch."""
        return lambda rows, number: (self.commit(rows, writer=writer, batch=number), None)[1]

    def expire(self, keep: int = 1) -> int:
        """Drop all but the newest versions, and the file sets that only the others name; returns how many folders went."""
        found = self.versions()
        for version in found[:-keep]:
            self.folder.drop(f"manifests/v={version:010d}.json")
        named = {f for version in found[-keep:] for entries in self.manifest(version).sets.values() for f, _, _ in entries}
        newest, went = found[-1] if found else -1, 0
        for name in self.folder.names("data"):
            if int(name.lstrip("cv")) > newest:
                continue  # of a commit under way
            own = [f"data/{name}/{b}" for b in self.folder.names(f"data/{name}") if b.startswith(_BUCKET)]
            spare = [f for f in own if f not in named]
            for f in spare if len(spare) < len(own) else [f"data/{name}"]:
                self.folder.drop(f)
                went += 1
        return went

    def by_bucket(self, rows: DataFrame) -> tuple[DataFrame, list[str]]:
        """Rows dealt by bucket and, as far as spark.sql.shuffle.partitions goes, by key within one; the columns that were added for it."""
        own, slices = self.manifest() or self, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets
        added = rows.select("*", self._bucket(own).alias(_BUCKET), F.pmod(F.hash(*self.key), F.lit(max(1, slices))).alias(_FILE))
        return added.repartition(own.buckets * max(1, slices), _BUCKET, _FILE), [_BUCKET, _FILE]

    def _batch(self, rows: DataFrame | None, gone: DataFrame | Column | None, old: Manifest | None, distinct: bool) -> DataFrame:
        if isinstance(gone, Column):
            return rows.withColumn(_DELETED, gone)
        parts = []
        if rows is not None:
            own = rows
            if not self.groups and not distinct:
                rank = [*([F.desc_nulls_last(self.order)] if self.order else []), F.desc(F.to_json(F.struct(*rows.columns)))]
                own = rows.withColumn("__at", F.row_number().over(Window.partitionBy(*self.key).orderBy(*rank))).where("__at = 1").drop("__at")
            parts.append(own.withColumn(_DELETED, F.lit(False)))
        if gone is not None:
            keys = gone.select(*self.key).distinct().withColumn(_DELETED, F.lit(True))
            if rows is not None:
                if not distinct:
                    keys = keys.join(rows.select(*self.key).distinct(), self.key, "left_anti")
                keys = keys.select(*(F.col(f.name) if f.name in (*self.key, _DELETED) else F.lit(None).cast(f.dataType).alias(f.name) for f in parts[0].schema))
            elif old is not None:
                keys = keys.select(*(F.col(f.name) if f.name in self.key else F.lit(None).cast(f.dataType).alias(f.name) for f in old.schema), _DELETED)
            parts.append(keys)
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _bucket(self, own: Manifest):
        return F.pmod(F.xxhash64(*own.by), F.lit(own.buckets)).cast("int")

    def _load(self, own: Manifest, folders: list[str]) -> DataFrame:
        schema = T.StructType([*own.schema.fields, T.StructField(_SEQ, T.LongType()), T.StructField(_DELETED, T.BooleanType())])
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def _newest(self, rows: DataFrame, *by: str) -> DataFrame:
        return rows.withColumn("__last", F.max(_SEQ).over(Window.partitionBy(*by, *self.key))).where(F.col("__last") == F.col(_SEQ)).drop("__last")

    def _dealt(self, rows: DataFrame, own: Manifest) -> DataFrame:
        """Rows by bucket; those of a key together."""
        file = [F.pmod(F.hash(*own.key), F.lit(self.files)).alias(_FILE)] if self.files > 1 else []
        return rows.select("*", self._bucket(own).alias(_BUCKET), *file).repartition(own.buckets * self.files, _BUCKET, *([_FILE] if file else []))

    def _write(self, dealt: DataFrame, folder: str, own: Manifest) -> dict[int, int]:
        """Bytes by bucket."""
        dealt.drop(_FILE).sortWithinPartitions(_BUCKET, *own.by).write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{self.path}/{folder}", compression=self.codec)
        return {int(n.partition("=")[2]): self.folder.size(f"{folder}/{n}") for n in self.folder.names(folder) if n.startswith(_BUCKET)}

    def _merged(self, rows: DataFrame, whole: list[int]) -> DataFrame:
        """The newest rows of dealt ones; without tombstones in buckets that are merged as a whole."""
        rows = self._newest(rows, _BUCKET, *([_FILE] if self.files > 1 else []))  # as the rows are dealt, without another shuffle
        return rows.where(~(F.col(_DELETED) & F.col(_BUCKET).isin(whole)))

    def _compact(self, own: Manifest) -> None:
        """Merge the newest file sets of those buckets where they have grown; tombstones go once nothing older is left."""
        first: dict[int, int] = {}
        for bucket, entries in own.sets.items():
            at, size = len(entries) - 1, entries[-1][1]
            while at > 0 and entries[at - 1][1] <= RATIO * size:
                at -= 1
                size += entries[at][1]
            if at < len(entries) - 1:
                first[bucket] = at
        if not first:
            return
        whole = [b for b, at in first.items() if at == 0]
        rows = self._dealt(self._load(own, [f for b, at in first.items() for f, _, _ in own.sets[b][at:]]), own)
        rows = self._merged(rows, whole)
        folder = f"data/c{own.version:010d}"
        sizes = self._write(rows, folder, own)
        merged: dict[int, list] = defaultdict(list)
        for bucket, at in first.items():
            kept = own.sets[bucket][:at]
            if bucket in sizes:  # else nothing is left of it
                kept = [*kept, (f"{folder}/{_BUCKET}={bucket}", sizes[bucket], at > 0 and any(d for _, _, d in own.sets[bucket][at:]))]
                own.written += sizes[bucket]
            merged[bucket] = kept
        own.sets |= merged
        own.sets = {b: entries for b, entries in own.sets.items() if entries}
