"""Questions answered from their own documents: scoped hits, numbered sources and question-answer pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import numeric, slots
from docquarry.operators import search

#: Sources of an answer, and the least cosine of a hit.
MOST_SOURCES, LEAST = 5, 0.25
NO_ANSWER = "No passage answers this question."


def scoped_hits(asked: DataFrame, points: DataFrame, k: int, least: float = LEAST) -> DataFrame:
    """The best k points of each question's own document.

    asked has (query_id, doc_id, vector), points (id, doc_id, embedding) and
    more. A document is compared with its own questions only, so the work grows
    with the corpus and the questions of one document.
    """
    near = F.round(numeric.cosine(F.col("embedding"), F.col("vector")), 6)
    scored = points.join(asked.select("query_id", "doc_id", "vector"), "doc_id").withColumn("score", near).where(F.col("score") >= least)
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.drop("embedding", "vector").withColumn("rank", at).where(F.col("rank") <= k)


def numbered_sources(hits: DataFrame) -> DataFrame:
    """(query_id, context, sources) of hits (query_id, final_rank, doc_id, page, score, text); blank ones have no number."""
    told = hits.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    index = F.row_number().over(Window.partitionBy("query_id").orderBy("final_rank"))
    source = F.struct("source_index", "doc_id", F.col("page").cast("string").alias("page"), "score", "text")
    own = told.withColumn("source_index", index).groupBy("query_id").agg(F.sort_array(F.collect_list(source)).alias("sources"))
    block = lambda s: F.format_string("[source %d: %s page %s]\n%s", s["source_index"], s["doc_id"], F.coalesce(s["page"], F.lit("unknown")), s["text"])
    return own.select("query_id", F.array_join(F.transform("sources", block), "\n").alias("context"), "sources")


def qa_pairs(asked: DataFrame, points: DataFrame, k: int = MOST_SOURCES) -> DataFrame:
    """(id, doc_id, question, answer, sources) of questions (query_id, doc_id, query).

    Twice as many hits as sources go to the reranker. A question without hits
    gets a fixed answer and no sources.
    """
    vectors = slots.embedded(asked, "query", "vector")
    hits = scoped_hits(vectors, points, 2 * k).join(asked.select("query_id", "query"), "query_id")
    known = asked.join(numbered_sources(search.reranked(hits, k)), "query_id", "left")
    made = slots.completed(known.withColumn("prompt", F.concat_ws("\n\n", "query", "context")))
    answer = F.when(F.col("sources").isNotNull() & (F.trim("answer") != ""), F.col("answer")).otherwise(NO_ANSWER)
    return made.select(F.col("query_id").alias("id"), "doc_id", F.col("query").alias("question"), answer.alias("answer"), F.coalesce("sources", F.array()).alias("sources"))
