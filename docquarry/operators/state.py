"""Mutations as pure functions: what a table holds after an upsert, merge, delete or update."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, key: Sequence[str], order: str | None = None) -> DataFrame:
    """Rows of both by key; new ones win, of several new ones the one with the greatest ``order``."""
    own = new.withColumn("__v", F.lit(1)).unionByName(old.withColumn("__v", F.lit(0)))
    rank = [F.desc("__v"), *([F.desc(order)] if order else [])]
    at = F.row_number().over(Window.partitionBy(*key).orderBy(*rank, *[F.col(c) for c in old.columns if c not in key]))
    return own.withColumn("__at", at).where("__at = 1").drop("__v", "__at")


def merged(old: DataFrame, new: DataFrame, key: Sequence[str], on_create: Sequence[str], on_match: Sequence[str]) -> DataFrame:
    """Rows of both by key: columns of on_match come from the new row, those only of on_create stay as they were."""
    a, b = old.withColumn("__old", F.lit(True)), new
    columns = [c for c in old.columns if c not in key]
    joined = a.join(b.select(*key, *(F.col(c).alias(f"__new_{c}") for c in columns), F.lit(True).alias("__there")), list(key), "full_outer")
    own = []
    for c in columns:
        fresh = F.col(f"__new_{c}")
        if c in on_match:
            own.append(F.when(F.col("__there"), F.coalesce(fresh, F.col(c))).otherwise(F.col(c)).alias(c))
        else:
            own.append(F.when(F.col("__old"), F.col(c)).otherwise(fresh if c in on_create else F.lit(None)).alias(c))
    return joined.select(*key, *own)


def deleted(rows: DataFrame, gone: DataFrame, key: Sequence[str]) -> DataFrame:
    return rows.join(gone.select(*key).distinct(), list(key), "left_anti")


def patched(rows: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """Rows with ``column`` replaced where ``changes`` (key, column) has a value."""
    new = changes.select(key, F.col(column).alias("__new"))
    return rows.join(new, key, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def ensured(rooms: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of ``rooms``, and those of ``wanted`` whose key is not there."""
    return rooms.unionByName(wanted.join(rooms.select(key), key, "left_anti"))


def save(rows: DataFrame, path: str, partition: Sequence[str] = ()) -> None:
    """Replace a table by writing; the rows must not be read from ``path`` itself."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)
