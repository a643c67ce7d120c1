"""Queries over events as they would be in a stream, their SQL, and one that runs as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docquarry.plans import stored, views
from docquarry.plans.shared_folder import shared_folder
from docquarry.sources import files
from docquarry.sources.upserts import UpsertTable
from docquarry.streaming import events, ingest


def _events(spark, sf_dir):
    return views.table(spark, sf_dir, "events")


def events_tumbling(spark, sf_dir):
    return events.tumbling(_events(spark, sf_dir))


def events_sliding(spark, sf_dir):
    return events.sliding(_events(spark, sf_dir))


def events_session(spark, sf_dir):
    return events.sessions(_events(spark, sf_dir))


def stream_room_counts(spark, sf_dir):
    """Counts of rooms, by a stream over the file of conversations that upserts each batch."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    source = views.table(spark, sf_dir, "conversations")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/conversations.parque[t]")  # a pattern, as a single file is no source folder
    messages = stream.select(F.col("conv_id").alias("room_id"), F.timestamp_seconds(F.col("turn") * 60).alias("ts"))
    events.run_once(events.room_counts(messages), events.upsert_batches(f"{folder}/rooms", ["room_id"]), f"{folder}/checkpoint", "update")
    return events.version(spark, f"{folder}/rooms").select("room_id", "message_count", F.unix_seconds("updated_at").alias("updated_at"))


def stream_messages(spark, sf_dir):
    """Messages of conversations that come in a stream of small batches, one in three again with another text, and rooms that are deleted."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    own = views.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("room_id"), "turn", F.col("text").alias("content"), F.lit(0).alias("edit"))
    edited = own.where("turn % 3 = 0").select("room_id", "turn", F.concat(F.lit("edited: "), F.coalesce("content", F.lit(""))).alias("content"), F.lit(1).alias("edit"))
    for part in (own, edited):
        part.repartition(3).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    table = UpsertTable(spark, f"{folder}/messages", ["room_id", "turn"], "edit")
    events.run_once(stream, table.sink("messages"), f"{folder}/checkpoint")
    rows = table.read()
    table.commit(None, rows.where("room_id % 5 = 0"))
    table.expire()
    return table.read().select("room_id", "turn", F.md5(F.col("content").cast("binary")).alias("digest"))


#: Documents of a file.
VOLUME = 50


def _ingested(spark, sf_dir):
    """The store of these files; three queries read what one ingest made."""
    return stored.ingested_documents(spark, sf_dir, lambda: _ingest(spark, sf_dir))


def _ingest(spark, sf_dir):
    """Files of fifty documents, a page each, taken in by a stream; every seventh file has bytes that are no text."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    volume = F.floor(F.col("doc_id") / VOLUME).cast("long")
    broken = F.when(volume % 7 == 3, F.expr("cast(X'C328' as string)")).otherwise("")
    docs = views.table(spark, sf_dir, "documents").where("doc_id is not null").select(volume.alias("volume"), F.concat(broken, F.translate(F.coalesce("text", F.lit("")), "\f", " ")).alias("text"), "doc_id")
    ordered = docs.repartition("volume").sortWithinPartitions("volume", "doc_id").drop("doc_id")
    ordered.write.partitionBy("volume").option("lineSep", "\f").text(f"{folder}/in")
    store = ingest.Store(spark, f"{folder}/store")
    ingest.ingest(store, f"{folder}/in", f"{folder}/checkpoint", files.strict_pages, doc_id=F.regexp_extract("path", "volume=([^/]+)", 1), nested=True)
    return store


def ingest_pages(spark, sf_dir):
    own = _ingested(spark, sf_dir).pages.read()
    return own.select(F.col("doc_id").cast("long").alias("volume"), "page", F.md5(F.col("text").cast("binary")).alias("digest"))


def ingest_dead_letters(spark, sf_dir):
    own = _ingested(spark, sf_dir).dead_letters.read()
    return own.select(F.col("doc_id").cast("long").alias("volume"), F.substring_index("error", ":", 1).alias("error"))


def ingest_log(spark, sf_dir):
    own = _ingested(spark, sf_dir).log.read()
    return own.groupBy("status").agg(F.count("*").alias("files"), F.sum("pages").alias("pages"), F.sum("refused").alias("refused"))


_PAPERS = f"""v AS (SELECT doc_id // {VOLUME} AS volume, translate(coalesce(text, ''), chr(12), ' ') AS text, row_number() OVER (PARTITION BY doc_id // {VOLUME} ORDER BY doc_id)::INTEGER AS page FROM documents),
p AS (SELECT volume, page, text FROM v WHERE volume % 7 <> 3 AND regexp_matches(text, '\\S'))"""

QUERIES = {
    "events_tumbling": (events_tumbling, "SELECT epoch(date_trunc('day', ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"),
    "events_sliding": (events_sliding, "SELECT ((epoch(ts)::BIGINT // 21600) * 21600 - k * 21600)::BIGINT AS start, event_type, count(*) AS n FROM (SELECT *, floor(epoch(ts))::BIGINT AS s FROM events), range(0, 2) r(k) GROUP BY 1, 2".replace("epoch(ts)::BIGINT", "s")),
    "events_session": (events_session, """WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOURS THEN 0 ELSE 1 END AS new FROM events),
      g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o) SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, count(*) AS n FROM g GROUP BY user_id, s"""),
    "stream_messages": (stream_messages, "SELECT conv_id AS room_id, turn, md5(CASE WHEN turn % 3 = 0 THEN 'edited: ' || coalesce(text, '') ELSE text END) AS digest FROM conversations WHERE conv_id % 5 <> 0"),
    "ingest_pages": (ingest_pages, f"WITH {_PAPERS} SELECT volume, page, md5(text) AS digest FROM p"),
    "ingest_dead_letters": (ingest_dead_letters, f"WITH {_PAPERS} SELECT DISTINCT volume, 'UnicodeDecodeError' AS error FROM v WHERE volume % 7 = 3"),
    "ingest_log": (ingest_log, f"WITH {_PAPERS} SELECT 'ok' AS status, count(DISTINCT volume) AS files, count(*) AS pages, 0::BIGINT AS refused FROM p UNION ALL SELECT 'failed', count(DISTINCT volume), 0, NULL FROM v WHERE volume % 7 = 3"),
    "stream_room_counts": (stream_room_counts, "SELECT conv_id AS room_id, count(*) AS message_count, max(turn) * 60 AS updated_at FROM conversations GROUP BY conv_id"),
}
