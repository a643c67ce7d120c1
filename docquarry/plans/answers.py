"""Queries around hits, constraints, prompts and results, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.functions import numeric, slots, text
from docquarry.operators import chat, evidence, generation, graph, search
from docquarry.plans import views
from docquarry.plans.retrieval import COSINE, _topk

P = views.PAGES


def _near(spark, sf_dir, k):
    return search.dense_topk(views.points(spark, sf_dir), views.vector_queries(spark, sf_dir), k)


def valid_hits(spark, sf_dir):
    own = views.pages(spark, sf_dir).select("doc_id", F.when(F.col("page") % 9 > 0, F.col("page")).alias("page"), F.when(F.col("page") % 2 == 0, F.col("text")).alias("text"), F.col("text").alias("content"))
    return evidence.valid_hits(own).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def shown_evidence(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    own = _near(spark, sf_dir, 12).join(views.points(spark, sf_dir).select("id", "type"), "id").join(docs, "id")
    own = own.withColumns({"level": F.when(F.col("id") % 2 == 0, "row").otherwise("table"), "type": F.when(F.col("id") % 3 == 0, "").otherwise(F.col("type"))})
    return evidence.shown_evidence(own)


def table_flags(spark, sf_dir):
    hits = _near(spark, sf_dir, 1).join(views.points(spark, sf_dir).select("id", "type"), "id")
    asked = views.vector_queries(spark, sf_dir).select("query_id", F.when(F.col("query_id") % 300 == 0, F.array(F.lit("table_row"))).otherwise(F.array(F.lit("paragraph"))).alias("types"))
    return evidence.table_flags(hits, asked)


def merged_constraints(spark, sf_dir):
    items = views.table(spark, sf_dir, "benchmark")
    a = items.where("item_id % 3 <> 0").select(F.col("item_id").alias("query_id"), F.array(F.concat(F.lit("d"), (F.col("item_id") % 4).cast("string"))).alias("doc_ids"), F.array((F.col("item_id") % 5).cast("int")).alias("pages"), F.array(F.lit("paragraph")).alias("content_types"))
    b = items.where("item_id % 2 = 0").select(F.col("item_id").alias("query_id"), F.array(F.lit("d1")).alias("doc_ids"), F.array(F.lit(2), F.lit(3)).alias("pages"), F.array(F.lit("paragraph"), F.lit("table_row")).alias("content_types"))
    own = evidence.merged_constraints(a, b)
    return own.select("query_id", *(F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("doc_ids", "pages", "content_types")))


def named_documents(spark, sf_dir):
    """Names of suppliers in questions made of them, some with a letter wrong."""
    own = views.table(spark, sf_dir, "supplier")
    name = F.regexp_replace("s_name", "#", "")
    queries = own.select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("show me "), F.when(F.col("s_suppkey") % 2 == 0, F.regexp_replace(name, "upp", "uqp")).otherwise(name)).alias("query"))
    return evidence.named_documents(queries, own.select(name.alias("doc_id")))


def fuzzy_dedup(spark, sf_dir):
    """Lines of documents that are not nearly an earlier line of their document; documents have no pages, so each is one."""
    own = views.pages(spark, sf_dir).where(F.trim("text") != "")
    lines = own.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("page"), F.col("page").alias("pos"), "text")
    return evidence.without_table_echoes(lines)


def numeral_pages(spark, sf_dir):
    digits = F.translate((F.col("item_id") % 90 + 10).cast("string"), "0123456789", "零一二三四五六七八九")
    own = views.table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("請看第"), digits, F.lit("頁")).alias("q"))
    return own.select("item_id", F.array_join(F.transform(evidence.numeral_pages(F.col("q")), lambda x: x.cast("string")), ",").alias("pages"))


def gap_paragraphs(spark, sf_dir):
    own = views.pages(spark, sf_dir).select(F.col("doc_id"), F.lit(1).alias("page"), F.col("page").alias("line_no"), ((F.col("page") * 37) % 50).cast("double").alias("y0"), "text")
    return evidence.gap_paragraphs(own).select("doc_id", "line_no", "paragraph")


def tagged_text(spark, sf_dir):
    return evidence.tagged_text(views.pages(spark, sf_dir)).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


def document_summaries(spark, sf_dir):
    return evidence.summarized(views.table(spark, sf_dir, "documents").select("doc_id", "text"))


def combined_results(spark, sf_dir):
    own = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.when(F.col("o_orderkey") % 2 == 0, "Vector").otherwise("Graph").alias("part"), (F.col("o_orderstatus") != "F").alias("success"), F.lit(1).alias("indexed"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderpriority")).alias("error"))
    return evidence.combined_results(own)


def prompts(spark, sf_dir):
    own = views.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.when(F.col("item_id") % 2 == 0, "User: hi").alias("history"), F.when(F.col("item_id") % 3 == 0, "a file").otherwise("").alias("summary"), F.when(F.col("item_id") % 5 > 0, "one\ntwo").alias("documents"))
    return evidence.prompts(own)


def documents_scroll(spark, sf_dir):
    return evidence.documents_scroll(views.points(spark, sf_dir).drop("embedding"), "d3")


def table_pages(spark, sf_dir):
    own = views.table(spark, sf_dir, "nation")
    return evidence.with_pages(own.select(F.col("n_name").alias("table_id"), "n_regionkey"), own.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("table_id"), F.col("n_nationkey").alias("page")))


def term_pairs(spark, sf_dir):
    return evidence.term_pairs(spark)


def similar_suggestions(spark, sf_dir):
    """Suggestions near a question, of its own documents only, above a threshold."""
    own = views.points(spark, sf_dir).where(search.payload_filter(types=["paragraph"]))
    return search.dense_topk(own, views.vector_queries(spark, sf_dir), 5, 0.1)


def graph_retrieve(spark, sf_dir):
    """Seeds by vector and what a walk of two steps from their sources adds; the lists are not merged."""
    docs = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    near = _near(spark, sf_dir, 3)
    seeds = near.join(docs, "id").select(F.col("source").alias("id")).distinct()
    walked = graph.expand(views.edges(spark, sf_dir), seeds, 2, 10, relations=("REPORTED", "HAS_CHUNK"))
    return near.select(F.lit("seed").alias("kind"), F.col("query_id").cast("string").alias("origin"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("chunk"), "score").unionByName(walked.select(F.lit("walk").alias("kind"), F.col("seed").alias("origin"), "chunk", F.col("bonus").alias("score")))


def answer_extractive(spark, sf_dir):
    """Answers of the offline completion over the cited context of each question."""
    docs = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    hits = _near(spark, sf_dir, 5).join(views.points(spark, sf_dir).drop("embedding"), "id").join(docs, "id")
    made = slots.completed(chat.context_blocks(hits).withColumnRenamed("context", "prompt"))
    return made.join(chat.answerable(hits), "query_id").select("query_id", "answer", "answerable")


def suggestions(spark, sf_dir):
    """Up to three questions for each document, parsed from the offline completion."""
    own = slots.completed(chat.doc_context(views.pages(spark, sf_dir)).withColumnRenamed("context", "prompt"))
    return own.select("doc_id", F.posexplode(text.parsed_questions(F.regexp_replace("answer", r"\. ", ".\n"), 3)).alias("place", "question"))


def scoped_hits(spark, sf_dir):
    """The best ten points of each document for its first one as a question."""
    points = views.points(spark, sf_dir)
    asked = points.groupBy("doc_id").agg(F.min("id").alias("query_id"), F.min_by("embedding", "id").alias("vector"))
    return generation.scoped_hits(asked, points, 10, 0.1).select("query_id", "doc_id", "id", "score", "rank")


def embed_texts(spark, sf_dir):
    """Vectors of benchmark passages by the offline embedder, with their length and width."""
    own = slots.embedded(views.table(spark, sf_dir, "benchmark"))
    return own.select("item_id", F.size("embedding").alias("width"), F.round(numeric.cosine(F.col("embedding"), F.col("embedding")), 6).alias("self"), F.size(numeric.repaired_vector(F.col("embedding"), 80)).alias("repaired"))


def entity_triples(spark, sf_dir):
    """Triples that patterns find in sentences about suppliers, cleaned."""
    own = views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.concat(F.lit("Company"), F.col("s_suppkey").cast("string"), F.lit(" operates in Nation"), F.col("s_nationkey").cast("string"), F.lit(".")).alias("text"))
    return graph.sanitized(slots.extracted_triples(own))


QUERIES = {
    "valid_hits": (valid_hits, f"SELECT doc_id, count(*) AS n, sum(length(text))::BIGINT AS chars FROM ({P}) WHERE page % 9 > 0 AND trim(text, ' ') <> '' GROUP BY doc_id"),
    "shown_evidence": (shown_evidence, f"""WITH h AS (SELECT h.query_id, h.id, h.rank, CASE WHEN h.id % 3 = 0 THEN '' ELSE p.type END AS type, CASE WHEN h.id % 2 = 0 THEN 'row' ELSE 'table' END AS level, d.text FROM ({_topk(12)}) h JOIN ({views.POINTS}) p ON p.id = h.id JOIN documents d ON d.doc_id = h.id)
      SELECT query_id, id, CASE WHEN type <> '' THEN type WHEN level = 'row' THEN 'table_row' ELSE 'table_summary' END AS shown_type, substr(text, 1, 100) AS preview, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, id)::INTEGER AS place FROM h) WHERE place <= 5"""),
    "table_flags": (table_flags, f"SELECT h.query_id, h.query_id % 300 = 0 OR p.type LIKE 'table%' AS tables FROM ({_topk(1)}) h JOIN ({views.POINTS}) p ON p.id = h.id"),
    "merged_constraints": (merged_constraints, """WITH a AS (SELECT item_id AS q, ['d' || (item_id % 4)::VARCHAR] AS d, [item_id % 5] AS p, ['paragraph'] AS c FROM benchmark WHERE item_id % 3 <> 0), b AS (SELECT item_id AS q, ['d1'] AS d, [2, 3]::BIGINT[] AS p, ['paragraph', 'table_row'] AS c FROM benchmark WHERE item_id % 2 = 0)
      SELECT q AS query_id, array_to_string(list_sort(list_distinct(list_concat(a.d, b.d))), ',') AS doc_ids, array_to_string(list_sort(list_distinct(list_concat(a.p, b.p))), ',') AS pages, array_to_string(list_sort(list_distinct(list_concat(a.c, b.c))), ',') AS content_types FROM a FULL JOIN b USING (q)"""),
    "named_documents": (named_documents, None),
    "fuzzy_dedup": (fuzzy_dedup, None),
    "numeral_pages": (numeral_pages, "SELECT item_id, (item_id % 90 + 10)::VARCHAR AS pages FROM benchmark"),
    "gap_paragraphs": (gap_paragraphs, f"""WITH g AS (SELECT doc_id, page AS line_no, CASE WHEN abs((page * 37) % 50 - lag((page * 37) % 50) OVER (PARTITION BY doc_id ORDER BY page)) > 18 THEN 1 ELSE 0 END AS new FROM ({P}))
      SELECT doc_id, line_no, sum(new) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)::BIGINT AS paragraph FROM g"""),
    "tagged_text": (tagged_text, f"SELECT doc_id, md5(string_agg('[page ' || page::VARCHAR || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY page)) AS digest FROM ({P}) GROUP BY doc_id"),
    "document_summaries": (document_summaries, None),
    "combined_results": (combined_results, """WITH r AS (SELECT o_custkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 'Vector' ELSE 'Graph' END AS part, o_orderstatus <> 'F' AS success, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS error FROM orders)
      SELECT doc_id, bool_and(success) AS success, count(*) AS indexed, string_agg(part || ': ' || error, '; ' ORDER BY part || ': ' || error) FILTER (WHERE NOT success AND error IS NOT NULL) AS error FROM r GROUP BY doc_id"""),
    "prompts": (prompts, """SELECT item_id AS query_id, concat_ws(chr(10) || chr(10), CASE WHEN item_id % 2 = 0 THEN 'Conversation so far:' || chr(10) || 'User: hi' END, CASE WHEN item_id % 3 = 0 THEN 'Uploaded file:' || chr(10) || 'a file' END, CASE WHEN item_id % 5 > 0 THEN 'Passages:' || chr(10) || 'one' || chr(10) || 'two' END, 'Question: ' || text) AS prompt FROM benchmark"""),
    "documents_scroll": (documents_scroll, f"SELECT id, doc_id, page, type FROM ({views.POINTS}) WHERE doc_id = 'd3' ORDER BY id LIMIT 50"),
    "table_pages": (table_pages, "SELECT n_name AS table_id, n_regionkey, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey::VARCHAR ELSE 'unknown' END AS page FROM nation"),
    "term_pairs": (term_pairs, "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {v}::DOUBLE)" for a, b, v in evidence.TERM_PAIRS) + ") t(text1, text2, label)"),
    "similar_suggestions": (similar_suggestions, _topk(5, "p.type = 'paragraph'", 0.1)),
    "graph_retrieve": (graph_retrieve, None),
    "answer_extractive": (answer_extractive, None),
    "suggestions": (suggestions, None),
    "scoped_hits": (scoped_hits, f"""WITH p AS ({views.POINTS}), q AS (SELECT doc_id AS asked, min(id) AS query_id, arg_min(embedding, id) AS vector FROM p GROUP BY doc_id)
      SELECT query_id, doc_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM (SELECT query_id, doc_id, id, {COSINE} AS score FROM q JOIN p ON doc_id = asked) WHERE score >= 0.1) WHERE rank <= 10"""),
    "embed_texts": (embed_texts, "SELECT item_id, 64::INTEGER AS width, 1.0::DOUBLE AS self, 80::INTEGER AS repaired FROM benchmark"),
    "entity_triples": (entity_triples, "SELECT 'Company' || s_suppkey::VARCHAR AS src, 'OPERATES_IN' AS rel, 'Nation' || s_nationkey::VARCHAR AS dst FROM supplier"),
}
