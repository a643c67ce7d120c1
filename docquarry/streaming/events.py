"""Streams: windows over events, room state, a bounded buffer, idempotent delivery and file ingestion.

Every transformation takes a batch or a streaming DataFrame alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docquarry.sources.upserts import UpsertTable

LATE = "1 hour"
BUFFER = 1024


def timed(events: DataFrame, late: str = LATE) -> DataFrame:
    """Events with a time that a watermark accepts."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return own.withWatermark("ts", late) if own.isStreaming else own


def tumbling(events: DataFrame, size: str = "1 day") -> DataFrame:
    """(start, event_type, n, total) by window."""
    own = timed(events).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return own.select(F.unix_seconds("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sliding(events: DataFrame, size: str = "12 hours", step: str = "6 hours") -> DataFrame:
    own = timed(events).groupBy(F.window("ts", size, step).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return own.select(F.unix_seconds("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "2 hours") -> DataFrame:
    """(user_id, start, n) of runs of a user's events without a longer pause."""
    own = timed(events).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return own.select("user_id", F.unix_seconds("w.start").alias("start"), "n")


def room_counts(messages: DataFrame) -> DataFrame:
    """(room_id, message_count, updated_at) of messages (room_id, ts, ...)."""
    return messages.groupBy("room_id").agg(F.count("*").alias("message_count"), F.max("ts").alias("updated_at"))


def delivered_once(messages: DataFrame, key: str, late: str = LATE) -> DataFrame:
    """One row a key; in a stream within the watermark's delay."""
    return messages.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if messages.isStreaming else messages.dropDuplicates([key])


def ring_buffer(messages: DataFrame, most: int = BUFFER) -> DataFrame:
    """After each batch, the ids of the last ``most`` messages (room_id, msg_id, seq) of the rooms that it touches."""

    def keep(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = list(zip(*held.get)) if held.exists else []
        for pdf in batches:
            rows += list(zip(pdf["seq"].tolist(), pdf["msg_id"].tolist()))
        rows = sorted(set(rows))[-most:]
        held.update(([r[0] for r in rows], [r[1] for r in rows]))
        yield pd.DataFrame({"room_id": [key[0]] * len(rows), "msg_id": [r[1] for r in rows], "place": range(1, len(rows) + 1)})

    return messages.groupBy("room_id").applyInPandasWithState(keep, "room_id long, msg_id string, place long", "seqs array<long>, ids array<string>", "update", GroupStateTimeout.NoTimeout)


def upsert_batches(path: str, key: list[str], order: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink whose table holds one row a key; a batch that is delivered again changes nothing, and writes follow the batch."""

    def write(batch: DataFrame, number: int) -> None:
        UpsertTable(batch.sparkSession, path, key, order).commit(batch, writer="stream", batch=number)

    return write


def version(spark: SparkSession, path: str, number: int | None = None) -> DataFrame | None:
    """The newest version of the table under ``path``, or that of a number; null if there is none."""
    return UpsertTable(spark, path, []).read(number)


def run_once(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Everything that is there now, then stop; the checkpoint goes on where an earlier run ended."""
    stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
