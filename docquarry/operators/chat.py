"""Messages and rooms: history, recency, decay search and contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import numeric, text

SEMANTIC, RECENT = 0.7, 0.3


def last_messages(messages: DataFrame, k: int) -> DataFrame:
    """The newest k messages of each room, with their place from the oldest of these on."""
    newest = F.row_number().over(Window.partitionBy("room_id").orderBy(F.desc("ts"), F.desc("msg_id")))
    kept = messages.withColumn("n", newest).where(F.col("n") <= k)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("room_id").orderBy("ts", "msg_id"))).drop("n")


def last_of_role(messages: DataFrame, role: str, default: str) -> DataFrame:
    """The last message of a role by room, or the default."""
    own = messages.groupBy("room_id").agg(F.max_by(F.when(F.col("role") == role, F.col("content")), F.when(F.col("role") == role, F.struct("ts", "msg_id"))).alias("content"))
    return own.withColumn("content", F.coalesce("content", F.lit(default)))


def room_stats(messages: DataFrame) -> DataFrame:
    return messages.groupBy("room_id").agg(F.count("*").alias("message_count"), F.max("ts").alias("updated_at"), F.min("ts").alias("created_at"))


def recent_rooms(rooms: DataFrame, k: int) -> DataFrame:
    return rooms.orderBy(F.desc("updated_at"), "room_id").limit(k)


def decayed(hits: DataFrame, as_of: Column, k: int) -> DataFrame:
    """Hits (query_id, id, score, ts) by 0.7 times the score and 0.3 times the decay of age."""
    both = F.round(SEMANTIC * F.col("score") + RECENT * numeric.time_decay(F.col("ts"), as_of), 6)
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("final"), "id"))
    return hits.withColumn("final", both).withColumn("place", at).where(F.col("place") <= k)


def chat_context(messages: DataFrame, k: int = 10, most: int = 200) -> DataFrame:
    """A text of the last k messages by room: role and the first ``most`` characters."""
    own = last_messages(messages, k)
    lines = F.transform(F.sort_array(F.collect_list(F.struct("place", F.concat_ws(": ", "role", F.substring("content", 1, most)).alias("line")))), lambda x: x["line"])
    return own.groupBy("room_id").agg(F.array_join(lines, "\n").alias("context"))


def context_blocks(hits: DataFrame, k: int = 8, most: int = 800) -> DataFrame:
    """A text by query of the best k hits (query_id, id, doc_id, page, score, text), numbered and cited."""
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    own = hits.withColumn("n", at).where(F.col("n") <= k)
    cited = F.concat(F.lit("[source "), F.col("n").cast("string"), F.lit(": "), F.col("doc_id"), F.lit(" "), F.col("page").cast("string"), F.lit(", "), F.format_string("%.3f", F.col("score")), F.lit("] "), text.truncated(F.col("text"), most))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("n", cited.alias("line")))), lambda x: x["line"])
    return own.groupBy("query_id").agg(F.array_join(lines, "\n").alias("context"))


def doc_context(chunks: DataFrame, blocks: int = 10, most: int = 200) -> DataFrame:
    """A text by document of its first chunks (doc_id, page, text), blank ones of these left out."""
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))
    own = chunks.withColumn("n", at).where(F.col("n") <= blocks).where(F.trim("text") != "")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("n", F.substring("text", 1, most).alias("line")))), lambda x: x["line"])
    return own.groupBy("doc_id").agg(F.array_join(lines, "\n").alias("context"))


def answerable(hits: DataFrame, least: float = 0.1) -> DataFrame:
    """Whether a query's best hit reaches ``least``."""
    return hits.groupBy("query_id").agg((F.max(F.coalesce("score", F.lit(0.0))) >= least).alias("answerable"))
