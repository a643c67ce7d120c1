"""Rooms, messages and tasks as state: every change takes tables and gives new ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Evidence that goes into an answer's context: usually, with graph evidence, and for tables.
CONTEXT, GRAPH_CONTEXT, TABLE_CONTEXT = 8, 15, 25


def created(messages: DataFrame) -> DataFrame:
    """(room_id, created_at, updated_at, message_count) of rooms, from their messages (room_id, ts)."""
    return messages.groupBy("room_id").agg(F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"), F.count("*").alias("message_count"))


def appended(rooms: DataFrame, messages: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rooms and messages after new messages; one that comes again replaces itself and counts once, and an unknown room is created.

    Of several new ones with one id the latest counts, of equally late ones the greatest by its other columns.
    """
    order = [F.desc("ts"), *(F.desc(c) for c in messages.columns if c not in ("msg_id", "ts"))]
    latest = new.withColumn("__at", F.row_number().over(Window.partitionBy("msg_id").orderBy(*order))).where("__at = 1").drop("__at")
    fresh = latest.join(messages.select("msg_id"), "msg_id", "left_anti")
    more = fresh.groupBy("room_id").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    both = rooms.join(more, "room_id", "full_outer")
    counted = (F.coalesce("message_count", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long")
    after = both.select("room_id", F.coalesce("created_at", "first").alias("created_at"), F.greatest(F.coalesce("updated_at", "last"), F.coalesce("last", "updated_at")).alias("updated_at"), counted.alias("message_count"))
    kept = messages.join(new.select("msg_id"), "msg_id", "left_anti")
    return after, kept.unionByName(latest.select(*messages.columns))


def cleared(rooms: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rooms and messages after the histories of ``gone`` (room_id) are dropped; their rooms stay, with no messages."""
    marked = rooms.join(gone.select("room_id").distinct().withColumn("gone", F.lit(True)), "room_id", "left")
    after = marked.withColumn("message_count", F.when(F.col("gone"), F.lit(0).cast("long")).otherwise(F.col("message_count"))).drop("gone")
    return after, messages.join(gone.select("room_id"), "room_id", "left_anti")


def looked_up(asked: DataFrame, cached: DataFrame, stored: DataFrame) -> DataFrame:
    """The rooms asked for, as the cache has them or else the store; ``origin`` says which, null where neither does."""
    own = asked.select("room_id").distinct()
    named = cached.select("room_id", "message_count", F.lit("cache").alias("origin"))
    rest = stored.select("room_id", "message_count", F.lit("store").alias("origin")).join(cached.select("room_id"), "room_id", "left_anti")
    return own.join(named.unionByName(rest), "room_id", "left")


def completed_tasks(tasks: DataFrame, done: DataFrame) -> DataFrame:
    """Tasks after ``done`` (task_id, success, message): open ones become completed, with progress 100, or failed; ended ones stay as they are."""
    open_now = F.col("status").isin("pending", "processing") & F.col("success").isNotNull()
    ended = F.when(F.col("success"), "completed").otherwise("failed")
    own = tasks.join(done, "task_id", "left")
    return own.select(
        "task_id", F.when(open_now, ended).otherwise(F.col("status")).alias("status"),
        F.when((open_now & F.col("success")) | (F.col("status") == "completed"), 100).otherwise(0).alias("progress"),
        F.when(open_now, F.col("message")).alias("message"),
    )


def batch_counts(results: DataFrame, *by: str) -> DataFrame:
    """How many of (status) succeeded and failed."""
    return results.groupBy(*by).agg(F.count_if(F.col("status") == "completed").alias("ok"), F.count_if(F.col("status") == "failed").alias("failed"))


def context_limit(tables: Column, graph: Column) -> Column:
    """How many pieces of evidence an answer reads."""
    return F.when(tables, TABLE_CONTEXT).when(graph, GRAPH_CONTEXT).otherwise(CONTEXT)


def context(hits: DataFrame, limits: DataFrame) -> DataFrame:
    """The best hits (query_id, id, score) of each query, as many as its limit (query_id, most), in score order."""
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return hits.join(limits, "query_id").withColumn("place", at).where(F.col("place") <= F.col("most")).drop("most")


def fallback_seeds(hits: DataFrame, chunks: DataFrame, preview: int = 100) -> DataFrame:
    """(hit, id): chunks (id, doc_id, page, text) of a hit's page (hit, doc_id, page, text) that contain the start of its text, for hits whose id no graph knows."""
    own = hits.select("hit", "doc_id", "page", F.substring(F.trim("text"), 1, preview).alias("start")).where(F.col("start") != "")
    return own.join(chunks.select("id", "doc_id", "page", "text"), ["doc_id", "page"]).where(F.col("text").contains(F.col("start"))).select("hit", "id")


def graph_text(edges: DataFrame, entities: int = 5, relations: int = 3) -> DataFrame:
    """(id, text): a vertex with its first neighbours and relations by name, as a line to read."""
    def first(column: str, most: int) -> DataFrame:
        at = F.row_number().over(Window.partitionBy("src").orderBy(column))
        top = edges.select("src", column).distinct().withColumn("at", at).where(F.col("at") <= most)
        return top.groupBy("src").agg(F.array_join(F.array_sort(F.collect_list(column)), ", ").alias(column))

    both = first("dst", entities).join(first("rel", relations), "src")
    return both.select(F.col("src").alias("id"), F.concat(F.col("src"), F.lit(": "), F.col("dst"), F.lit(" ("), F.col("rel"), F.lit(")")).alias("text"))
