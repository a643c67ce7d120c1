"""Hits, constraints and texts around retrieval: normalising, typing, fuzzy matching, prompts, summaries and results."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.functions import slots, text
from docquarry.operators import echoes, naming
from docquarry.operators.chunking import char_windows

#: Words that are never document ids.
COMMON = ("show", "me", "complete", "tables", "from", "page", "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by")
#: Labelled pairs of terms.
TERM_PAIRS = (
    ("營業收入", "營收", 0.95), ("淨利潤", "稅後淨利", 0.9), ("毛利率", "毛利", 0.85), ("資產負債表", "資產負債", 0.9), ("現金流量", "現金流", 0.95), ("股東權益", "股東報酬", 0.85),
    ("市場佔有率", "市場份額", 0.9), ("競爭優勢", "核心競爭力", 0.8), ("業務成長", "營業成長", 0.85), ("營業收入", "員工人數", 0.1), ("股價", "天氣", 0.0), ("財務報表", "產品介紹", 0.2),
)
FUZZY_ID, FUZZY_ROW, GAP = 80, 85, 18.0


def valid_hits(hits: DataFrame) -> DataFrame:
    """Hits with a page and a text that is not blank; ``text`` counts if it is there, else ``content``."""
    own = hits.withColumn("text", F.coalesce("text", "content")).where(F.col("page").isNotNull())
    return own.where(F.trim(F.coalesce("text", F.lit(""))) != "").drop("content")


def shown_evidence(hits: DataFrame, most: int = 5) -> DataFrame:
    """The first hits by query with a display type, its engine and a preview."""
    kind = F.coalesce(F.nullif("type", F.lit("")), F.when(F.col("level") == "row", "table_row").when(F.col("level") == "table", "table_summary").otherwise("unknown"))
    at = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id"))
    own = hits.withColumns({"shown_type": kind, "preview": F.substring("text", 1, 100), "place": at})
    return own.where(F.col("place") <= most).select("query_id", "id", "shown_type", "preview", "place")


def table_flags(hits: DataFrame, asked: DataFrame) -> DataFrame:
    """Whether a query (query_id, types) asks for tables or has hits of them."""
    any_hit = hits.groupBy("query_id").agg(F.max(F.col("type").startswith("table").cast("int")).alias("t"))
    wants = F.exists("types", lambda t: t.startswith("table"))
    return asked.join(any_hit, "query_id", "left").select("query_id", (F.coalesce(wants, F.lit(False)) | (F.coalesce("t", F.lit(0)) == 1)).alias("tables"))


def merged_constraints(parsed: DataFrame, override: DataFrame) -> DataFrame:
    """Sets of each field of both (query_id, doc_ids, pages, content_types) joined."""
    fields = ("doc_ids", "pages", "content_types")
    joined = parsed.join(override.select("query_id", *(F.col(f).alias(f"o_{f}") for f in fields)), "query_id", "full_outer")
    none = {"doc_ids": "array<string>", "pages": "array<int>", "content_types": "array<string>"}
    empty = lambda f: F.array().cast(none[f])
    return joined.select("query_id", *(F.array_sort(F.array_union(F.coalesce(f, empty(f)), F.coalesce(f"o_{f}", empty(f)))).alias(f) for f in fields))


def named_documents(queries: DataFrame, known: DataFrame) -> DataFrame:
    """(query_id, doc_id): known ids (doc_id) that a question (query_id, query) contains; without one, those most like one of its words."""
    return naming.named(queries, known, COMMON, FUZZY_ID)


def without_table_echoes(sentences: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Sentences (doc_id, page, pos, text) that are not nearly a table row (doc_id, page, text) of their page.

    Where rows have a ``pos`` too, only those before a sentence count; without
    rows, other sentences before it do.
    """
    return echoes.without_echoes(sentences, rows, FUZZY_ROW)


_ZH_PAGE = re.compile(f"第?([{text.NUMERALS}]+)(?:[到至\\-]第?([{text.NUMERALS}]+))?頁")


def numeral_pages(question: Column) -> Column:
    """Sorted pages that a question names in CJK numerals, ranges expanded."""

    @F.pandas_udf("array<int>")
    def pages(questions: pd.Series) -> pd.Series:
        def of(t: str | None) -> list[int]:
            out: set[int] = set()
            for a, b in _ZH_PAGE.findall(t or ""):
                first, last = slots.numeral(a), slots.numeral(b) if b else None
                if first is not None:
                    out.update(range(first, (first if last is None else last) + 1))
            return sorted(out)

        return questions.map(of)

    return pages(question)


def gap_paragraphs(lines: DataFrame, gap: float = GAP) -> DataFrame:
    """Lines (doc_id, page, line_no, y0, text) with the number of their paragraph: a new one after a wide gap."""
    own = Window.partitionBy("doc_id", "page").orderBy("line_no")
    new = (F.abs(F.col("y0") - F.lag("y0").over(own)) > gap).cast("int")
    return lines.withColumn("new", F.coalesce(new, F.lit(0))).withColumn("paragraph", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def tagged_text(pages: DataFrame) -> DataFrame:
    """(doc_id, text): all pages of a document in order, each after its number."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda x: F.concat(F.lit("[page "), x["page"].cast("string"), F.lit("]\n"), x["text"]))
    return pages.groupBy("doc_id").agg(F.array_join(parts, "\n\n").alias("text"))


def summarized(docs: DataFrame, size: int = 2000, overlap: int = 200) -> DataFrame:
    """(doc_id, summary) in two steps: windows are summarised, then their summaries in order."""
    first = slots.completed(char_windows(docs, size, overlap, until_end=False).withColumnRenamed("text", "prompt"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("win", "answer"))), lambda x: x["answer"])
    return slots.completed(first.groupBy("doc_id").agg(F.array_join(ordered, " ").alias("prompt")), out="summary").select("doc_id", "summary")


def combined_results(results: DataFrame) -> DataFrame:
    """One result by document of its parts (doc_id, part, success, indexed, error)."""
    errors = F.sort_array(F.collect_list(F.when(~F.col("success") & F.col("error").isNotNull(), F.concat_ws(": ", "part", "error"))))
    own = results.groupBy("doc_id").agg(F.bool_and("success").alias("success"), F.sum("indexed").alias("indexed"), F.array_join(errors, "; ").alias("error"))
    return own.withColumn("error", F.nullif("error", F.lit("")))


def prompts(rows: DataFrame) -> DataFrame:
    """(query_id, prompt) of (query_id, query, history, summary, documents), without the parts that are missing."""
    part = lambda title, c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(title), F.col(c)))
    return rows.select("query_id", F.concat_ws("\n\n", part("Conversation so far:\n", "history"), part("Uploaded file:\n", "summary"), part("Passages:\n", "documents"), F.concat(F.lit("Question: "), F.col("query"))).alias("prompt"))


def documents_scroll(points: DataFrame, doc_id: str, most: int = 50) -> DataFrame:
    return points.where(F.col("doc_id") == doc_id).orderBy("id").limit(most)


def with_pages(tables: DataFrame, pages: DataFrame) -> DataFrame:
    """Tables (table_id, ...) with their page as text, ``unknown`` where none is listed (table_id, page)."""
    return tables.join(pages.select("table_id", F.col("page").cast("string").alias("page")), "table_id", "left").withColumn("page", F.coalesce("page", F.lit("unknown")))


def term_pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TERM_PAIRS), "text1 string, text2 string, label double")


def health(vector: Column, graph: Column) -> Column:
    return F.when(vector & graph, "healthy").when(vector | graph, "degraded").otherwise("down")
