"""The service's surface as a Python API over DataFrames: ingest, ask, search, rooms, tasks and suggestions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import ids, slots, text
from docquarry.operators import chat, chunking, evaluate, generation, requests, state
from docquarry.plans.shared_folder import cut_lineage
from docquarry.sources import files

NO_ANSWER = generation.NO_ANSWER


@dataclass(frozen=True)
class Request:
    """A retrieval request; limits are clamped and a blank query is refused."""

    query: str
    top_k: int = 6
    threshold: float = 0.0
    doc_ids: tuple[str, ...] = ()
    pages: tuple[int, ...] = ()
    types: tuple[str, ...] = ()
    equal: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.query.strip():
            raise ValueError("the query is blank")
        object.__setattr__(self, "top_k", min(50, max(1, self.top_k)))
        object.__setattr__(self, "threshold", min(1.0, max(0.0, self.threshold)))


def numbered_id(column: Column) -> Column:
    """A 64-bit number for an id, for search operators that work on numbers."""
    return F.xxhash64(column)


def build_chunks(pages: DataFrame) -> DataFrame:
    """Chunks (id, doc_id, page, type, chunk_idx, text) of pages (doc_id, page, text)."""
    valid = pages.where((F.trim(F.coalesce("text", F.lit(""))) != "") & F.col("page").isNotNull())
    keyed = valid.select(F.concat_ws("\x1f", F.col("doc_id").cast("string"), F.col("page").cast("string")).alias("doc_id"), "text")
    own = chunking.token_chunks(keyed)
    parts = F.split("doc_id", "\x1f")
    named = own.select(parts[0].alias("doc_id"), parts[1].cast("int").alias("page"), F.lit("paragraph").alias("type"), "chunk_idx", "text")
    return named.withColumn("id", ids.chunk_id(*(F.col(c) for c in ("doc_id", "page", "type", "chunk_idx", "text"))))


def index(chunks: DataFrame) -> DataFrame:
    """Points: chunks with their vectors; a point's place in a collection is its id."""
    return slots.embedded(chunks).withColumn("num", numbered_id(F.col("id")))


ASKED = "query_id long, query string, top_k int, threshold double, doc_ids array<string>, pages array<int>, types array<string>, equal map<string,array<string>>"


def as_rows(spark: SparkSession, asked: list[Request]) -> DataFrame:
    """Requests as rows, numbered from 0; values of ``equal`` as text."""
    each = lambda v: [str(x) for x in v] if isinstance(v, (list, tuple)) else [str(v)]
    return spark.createDataFrame([(q, r.query, r.top_k, r.threshold, list(r.doc_ids), list(r.pages), list(r.types), {n: each(v) for n, v in r.equal.items()}) for q, r in enumerate(asked)], ASKED)


def retrieve(points: DataFrame, asked: list[Request], engine: str = "hybrid", known: DataFrame | None = None) -> DataFrame:
    """(query_id, id, doc_id, page, type, text, score, final_rank) for requests; engine is vector, keyword or hybrid.

    All requests are one plan, whatever their constraints. With ``known`` (doc_id)
    the questions themselves are parsed for constraints first.
    """
    numbered = points.withColumnsRenamed({"id": "chunk", "num": "id"})
    best = requests.retrieve(numbered, as_rows(points.sparkSession, asked), cut_lineage, known, engine=engine, parse=known is not None)
    return best.join(numbered.select("id", "chunk"), "id").select("query_id", F.col("chunk").alias("id"), "doc_id", "page", "type", "text", "score", "final_rank")


def engine_for(mode: Column, room_mode: Column, default: str = "hybrid") -> Column:
    """The asked engine, else the room's, else the default."""
    return F.coalesce(mode, room_mode, F.lit(default))


def answer(hits: DataFrame, requests: list[Request]) -> DataFrame:
    """(query_id, answer): a completion over the cited context, or a fixed text where nothing is relevant."""
    spark = hits.sparkSession
    asked = spark.createDataFrame([(q, r.query) for q, r in enumerate(requests)], "query_id long, query string")
    own = asked.join(chat.answerable(hits), "query_id", "left").join(chat.context_blocks(hits), "query_id", "left")
    made = slots.completed(own.withColumn("prompt", F.concat_ws("\n\n", "query", "context")))
    good = F.col("answerable") & (F.trim("answer") != "")
    return made.select("query_id", F.when(good, F.col("answer")).otherwise(NO_ANSWER).alias("answer"))


def suggestions(chunks: DataFrame, most: int = 5) -> DataFrame:
    """(suggestion_id, doc_id, question, popularity) from the context of each document."""
    prompts = chat.doc_context(chunks).select("doc_id", F.col("context").alias("prompt"))
    asked = slots.completed(prompts).select("doc_id", F.explode(text.parsed_questions(F.regexp_replace("answer", r"(?<=[.!?])\s+", "\n"), most)).alias("question"))
    return asked.select(F.substring(F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "question"), 256), 1, 32).alias("suggestion_id"), "doc_id", "question", F.lit(0.0).alias("popularity"))


def qa_pairs(points: DataFrame, most: int = 5) -> DataFrame:
    """Question-answer pairs of each document, up to ``most``; questions are made once and kept, as a model may not repeat itself."""
    asked = suggestions(points, most).dropDuplicates(["suggestion_id"]).select(F.col("suggestion_id").alias("query_id"), "doc_id", F.col("question").alias("query"))
    return generation.qa_pairs(cut_lineage(asked), points)


def post_message(messages: DataFrame, new: DataFrame) -> DataFrame:
    """The message table after new rows; a message that comes again replaces itself."""
    return state.upserted(messages, new, ["msg_id"])


def histories(messages: DataFrame, room_id, limit: int = 20) -> DataFrame:
    return chat.last_messages(messages.where(F.col("room_id") == room_id), min(100, max(1, limit))).orderBy("place")


def delete_room(tables: dict[str, DataFrame], room_id) -> dict[str, DataFrame]:
    """Every table without the room."""
    return {name: t.where(F.col("room_id") != room_id) for name, t in tables.items()}


def training_pairs(spark: SparkSession, pages: DataFrame, qa_path: str | None = None) -> DataFrame:
    """Positive and negative pairs, with QA sets if there are any."""
    own = evaluate.page_pairs(pages).select("text1", "text2", "label")
    return own.unionByName(files.read_qa(spark, qa_path)) if qa_path else own
