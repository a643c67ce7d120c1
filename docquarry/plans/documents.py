"""Queries over documents, pages, chunks, messages, tasks and answers, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.functions import ids, numeric, text
from docquarry.operators import chat, chunking, evaluate, html_tables, layout, search, state, tables
from docquarry.plans import views
from docquarry.plans.graphs import CHUNKS, TABLE_SUMMARIES
from docquarry.plans.retrieval import _topk

P, M, T = views.PAGES, views.MESSAGES, views.TASKS


def _docs(spark, sf_dir):
    return views.table(spark, sf_dir, "documents")


def doc_ids(spark, sf_dir):
    return views.pages(spark, sf_dir).where("source <> ''").select("source").distinct()


def valid_nodes(spark, sf_dir):
    own = views.pages(spark, sf_dir).where((F.trim("text") != "") & F.col("page").isNotNull())
    return own.groupBy("lang").agg(F.count("*").alias("nodes"), F.countDistinct("doc_id").alias("docs"))


def node_type_stats(spark, sf_dir):
    return views.pages(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(F.length("text")), 6).alias("avg_chars"))


def node_routing(spark, sf_dir):
    """How rows of each type go to the index: chunked, as tables, dropped or as they are."""
    route = F.when(F.col("type") == "paragraph", "chunk").when(F.col("type").isin("table_summary", "table_note", "table_chunk"), "table").when(F.col("type").isin("table_record", "table_column"), "drop").otherwise("pass")
    return views.points(spark, sf_dir).withColumn("route", route).groupBy("type", "route").agg(F.count("*").alias("n"))


def chunk_ids(spark, sf_dir):
    return views.chunks(spark, sf_dir).select("doc_id", "page", "id")


def hashes(spark, sf_dir):
    own = _docs(spark, sf_dir)
    doc, body = F.col("doc_id"), F.col("text")
    return own.select("doc_id", ids.temp_chunk_id(doc, F.lit(1), F.lit("paragraph"), body).alias("temp_id"), ids.parts_hash(doc, F.col("lang")).alias("part_hash"), ids.text_hash(F.regexp_replace(body, r"[^\x00-\x7f]", "?")).alias("text_hash"))


def text_hash_dedup(spark, sf_dir):
    own = views.pages(spark, sf_dir).where(F.trim("text") != "").withColumn("h", ids.text_hash(F.col("text")))
    return own.groupBy("h").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))


def sentence_split(spark, sf_dir):
    marked = F.translate(F.col("text"), ".!?;", "。！？；")
    return _docs(spark, sf_dir).select("doc_id", F.size(text.sentences(marked)).alias("sentences"), F.md5(F.array_join(text.sentences(marked), "\x01").cast("binary")).alias("digest"))


def paragraph_split(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(text.paragraphs(F.regexp_replace("text", "\n", "\n \n"))).alias("paragraphs"))


def resentenced(spark, sf_dir):
    own = text.resentenced(F.translate(F.col("text"), ".!?;", "。！？；"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(own.cast("binary")).alias("digest"), F.length(own).alias("chars"))


def normalize_compare(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(text.comparable(F.regexp_replace("text", r"[^\x00-\x7f]", "?")).cast("binary")).alias("digest"), F.length(text.label_key(F.col("text"))).alias("dense_chars"))


def char_windows_1200(spark, sf_dir):
    return chunking.char_windows(_docs(spark, sf_dir), 1200, 150).select("doc_id", "win", F.md5(F.col("text").cast("binary")).alias("digest"))


def char_windows_2000(spark, sf_dir):
    return chunking.char_windows(_docs(spark, sf_dir), 2000, 200, until_end=False).select("doc_id", "win", F.md5(F.col("text").cast("binary")).alias("digest"))


def unseen_windows(spark, sf_dir):
    windows = chunking.char_windows(_docs(spark, sf_dir), 1200, 150)
    return chunking.unseen_windows(windows, _docs(spark, sf_dir).select("text")).select("doc_id", "win", "hash")


def token_chunks(spark, sf_dir):
    return chunking.token_chunks(_docs(spark, sf_dir))


def table_chunks(spark, sf_dir):
    return chunking.packed_rows(tables.row_texts(views.records(spark, sf_dir)))


def html_cells(spark, sf_dir):
    return html_tables.html_tables(views.table(spark, sf_dir, "pages"))


def html_records(spark, sf_dir):
    """Cells of a page for each customer: a cell that spans all its orders, blanks in a column and a note."""
    order = F.struct(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderstatus")).alias("s"), F.col("o_orderpriority").alias("p"))
    rows = views.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(order)).alias("o"))
    plain = F.transform("o", lambda x: F.format_string("<td>%s</td><td>%s</td><td>%s</td></tr>", x["k"].cast("string"), x["s"], x["p"]))
    first = F.format_string('<table><tr><th>Customer</th><th>Order</th><th>Status</th><th>Priority</th></tr><tr><td rowspan="%s">C%s</td>', F.size("o").cast("string"), F.col("o_custkey").cast("string"))
    note = F.lit('<tr><td>Note</td><td colspan="3">Orders of one customer by their key</td></tr></table><table><tr><td>a</td></tr><tr><td>b</td></tr></table>')
    pages = rows.select(F.col("o_custkey").alias("page_id"), F.concat(first, F.array_join(plain, "<tr>"), note).alias("html"))
    return html_tables.first_tables(html_tables.html_tables(pages))


def parse_constraints(spark, sf_dir):
    """Constraints of questions made of benchmark passages and a page reference."""
    q = F.concat(F.lit("show tables on page "), (F.col("item_id") + 1).cast("string"), F.lit("-"), (F.col("item_id") + 3).cast("string"), F.lit(" and p."), F.col("item_id").cast("string"), F.lit(" "), F.col("text"))
    own = views.table(spark, sf_dir, "benchmark").select("item_id", q.alias("q"))
    return own.select("item_id", F.array_join(F.transform(text.page_numbers(F.col("q")), lambda x: x.cast("string")), ",").alias("pages"), F.array_join(text.content_types(F.col("q")), ",").alias("types"))


def clean_query(spark, sf_dir):
    own = views.table(spark, sf_dir, "benchmark")
    return own.select("item_id", text.clean_query(F.concat(F.lit("tables on page 3 "), F.col("text"))).alias("cleaned"))


def file_names(spark, sf_dir):
    name = F.concat(F.lit("Report "), F.col("doc_id").cast("string"), F.lit("_table"), (F.col("doc_id") % 50).cast("string"), F.lit("_p0"), (F.col("doc_id") % 100).cast("string"), F.lit(".html"))
    own = _docs(spark, sf_dir).select("doc_id", name.alias("n"))
    return own.select("doc_id", text.page_of_file(F.col("n")).alias("page"), text.table_of_file(F.col("n")).alias("table_no"), text.safe_file_name(F.col("n")).alias("safe"), text.doc_id_of_file(F.concat(F.lit("/in/"), F.col("n"))).alias("stem"))


def cell_numbers(spark, sf_dir):
    own = views.records(spark, sf_dir)
    v = F.col("val")
    return own.select("table_id", "row_idx", "col_idx", numeric.is_number(v).alias("is_number"), numeric.to_number(v).alias("num"), numeric.strict_number(v).alias("strict"), numeric.pure_number(v).alias("pure"), numeric.looks_numeric(v).alias("looks"))


def summary_plan(spark, sf_dir):
    n = F.length("text")
    return _docs(spark, sf_dir).select("doc_id", F.round(numeric.summary_guard(n, 6000), 6).alias("refused_minutes"), numeric.summary_strategy(n, 600).alias("strategy"), numeric.file_strategy(F.octet_length("text")).alias("size"))


def compression(spark, sf_dir):
    """Characters of tables' cells and of their offline summaries."""
    cells = views.records(spark, sf_dir)
    summaries = tables.summaries(cells).select("table_id", F.length("text").alias("s")).groupBy("table_id").agg(F.sum("s").alias("summary_chars"))
    own = cells.groupBy("table_id").agg(F.sum(F.length("val")).alias("chars")).join(summaries, "table_id")
    return own.select("table_id", "chars", "summary_chars", F.round(F.col("summary_chars") / F.col("chars"), 6).alias("ratio"))


def truncations(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", text.truncated(t, 100).alias("preview"), text.room_title(t).alias("title"), text.model_title(t).alias("model_title"))


def header_footer_lines(spark, sf_dir):
    """Documents as pages of their source: their lines from top to bottom, a title above nine in ten, a remark below every second, a disclaimer amid all."""
    docs, own = views.table(spark, sf_dir, "documents"), views.pages(spark, sf_dir)
    last = own.groupBy("doc_id").agg(F.max("page").alias("last"))
    top = F.when(F.col("page") == 1, 40.0).when(F.col("page") == F.col("last"), 745.0).otherwise(400.0)
    lines = own.join(last, "doc_id").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), "text", top.alias("y0"))
    added = ((F.concat(F.lit(" Report of "), F.col("source")), 20.0, "doc_id % 10 <> 0"), (F.lit("Confidential"), 770.0, "doc_id % 2 = 0"), (F.lit("Disclaimer"), 300.0, "true"))
    for line, y0, where in added:
        lines = lines.unionByName(docs.where(where).select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), line.alias("text"), F.lit(y0).alias("y0")))
    margin = layout.margin_lines(lines.withColumns({"y1": F.col("y0") + 10, "page_height": F.lit(800.0)}))
    return layout.repeated_lines(margin, docs.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page")))


def strip_headers(spark, sf_dir):
    own = views.pages(spark, sf_dir).select(F.col("doc_id"), "page", F.col("page").alias("line_no"), "text")
    most = own.where(F.trim("text") != "").groupBy("doc_id", F.trim("text").alias("text")).agg(F.count("*").alias("n")).where("n >= 2")
    return layout.page_texts(layout.without_lines(own, most).withColumn("page", F.lit(1))).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


def bbox_mask(spark, sf_dir):
    """Parts as boxes of brands' pages: those that meet no box of a larger size on their page."""
    own = views.table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("doc_id"), (F.col("p_size") % 5).alias("page"), (F.col("p_partkey") % 100).cast("double").alias("x0"), (F.col("p_partkey") % 37).cast("double").alias("y0"), F.col("p_size"))
    spans = own.withColumns({"x1": F.col("x0") + 3, "y1": F.col("y0") + 3})
    boxes = own.where("p_size > 40").select("doc_id", "page", F.col("x0").alias("bx0"), F.col("y0").alias("by0"), (F.col("x0") + 15).alias("bx1"), (F.col("y0") + 15).alias("by1"))
    return layout.outside_boxes(spans, boxes).select("p_partkey", "doc_id", "page")


def recent_messages(spark, sf_dir):
    return chat.last_messages(views.messages(spark, sf_dir), 3).select("room_id", "msg_id", "role", "place")


def last_answers(spark, sf_dir):
    return chat.last_of_role(views.messages(spark, sf_dir), "assistant", "no answer")


def room_stats(spark, sf_dir):
    own = chat.room_stats(views.messages(spark, sf_dir))
    return own.select("room_id", "message_count", F.unix_seconds("updated_at").alias("updated_at"), F.unix_seconds("created_at").alias("created_at"))


def recent_rooms(spark, sf_dir):
    own = chat.recent_rooms(chat.room_stats(views.messages(spark, sf_dir)), 10)
    return own.select("room_id", "message_count", F.unix_seconds("updated_at").alias("updated_at"))


def time_decay_search(spark, sf_dir):
    hits = search.dense_topk(views.points(spark, sf_dir), views.vector_queries(spark, sf_dir), 20)
    aged = hits.withColumn("ts", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 3600))
    return chat.decayed(aged, F.timestamp_seconds(F.lit(1_706_745_600)), 10).select("query_id", "id", "final", "place")


def chat_context(spark, sf_dir):
    return chat.chat_context(views.messages(spark, sf_dir)).select("room_id", F.md5(F.col("context").cast("binary")).alias("digest"), F.length("context").alias("chars"))


def doc_context(spark, sf_dir):
    return chat.doc_context(views.pages(spark, sf_dir)).select("doc_id", F.md5(F.col("context").cast("binary")).alias("digest"))


def _sourced(spark, sf_dir):
    docs = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    return search.dense_topk(views.points(spark, sf_dir), views.vector_queries(spark, sf_dir), 12).join(views.points(spark, sf_dir).drop("embedding"), "id").join(docs, "id")


def context_block(spark, sf_dir):
    return chat.context_blocks(_sourced(spark, sf_dir))


def relevance_gate(spark, sf_dir):
    return chat.answerable(_sourced(spark, sf_dir).withColumn("score", F.col("score") - 0.95))


def room_delete(spark, sf_dir):
    own = views.messages(spark, sf_dir)
    return state.deleted(own, own.where("role = 'system'"), ["room_id"]).select("room_id", "msg_id")


def upsert_points(spark, sf_dir):
    old = views.points(spark, sf_dir).select("id", "doc_id", "page")
    new = old.where("page >= 5").select((F.col("id") + 3).alias("id"), F.concat(F.col("doc_id"), F.lit("x")).alias("doc_id"), "page")
    return state.upserted(old, new, ["id"])


def merge_observations(spark, sf_dir):
    parts = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    old, new = parts.where("size <= 30"), parts.where("size >= 20").select("k", F.upper("name").alias("name"), (F.col("size") + 100).alias("size"))
    return state.merged(old, new, ["k"], ["name", "size"], ["size"])


def set_payload(spark, sf_dir):
    own = views.table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("popularity"))
    return state.patched(own, own.where("popularity < 5").select("s_suppkey", (F.col("popularity") + 50).alias("popularity")), "s_suppkey", "popularity")


def ensure_rooms(spark, sf_dir):
    rooms = views.messages(spark, sf_dir).select("room_id").distinct().withColumn("made", F.lit(False))
    wanted = views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("room_id")).withColumn("made", F.lit(True))
    return state.ensured(rooms, wanted, "room_id")


def task_stats(spark, sf_dir):
    return views.tasks(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("avg_value"))


def newest_tasks(spark, sf_dir):
    return views.tasks(spark, sf_dir).where("status = 'completed'").orderBy(F.desc("started_at"), F.desc("task_id")).limit(20).select("task_id", "owner", "status")


def task_progress(spark, sf_dir):
    """Percent done and seconds left of each owner, by finished tasks."""
    own = views.tasks(spark, sf_dir).groupBy("owner").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("done"), (F.unix_seconds(F.max("started_at")) - F.unix_seconds(F.min("started_at"))).alias("elapsed"))
    eta = F.when(F.col("done") > 0, F.floor(F.col("elapsed") * (F.col("total") - F.col("done")) / F.col("done")))
    return own.select("owner", F.floor(100 * F.col("done") / F.col("total")).alias("percent"), eta.alias("eta_seconds"))


def system_status(spark, sf_dir):
    """Rows of each store and overall health."""
    counts = None
    for name in ("documents", "embeddings", "conversations"):
        own = views.table(spark, sf_dir, name).agg(F.count("*").alias("rows")).select(F.lit(name).alias("store"), "rows")
        counts = own if counts is None else counts.unionByName(own)
    return counts.withColumn("health", F.when(F.col("rows") > 0, "healthy").otherwise("degraded"))


def _answers(spark, sf_dir):
    own = views.messages(spark, sf_dir)
    ask = own.where("role = 'user'").select("room_id", (F.col("turn") + 1).alias("turn"), F.concat("content", F.lit(" 年度 %")).alias("question"))
    got = own.where("role = 'assistant'").select("room_id", "turn", F.concat(F.col("content"), F.when(F.col("turn") % 3 == 0, "年 12%").otherwise(""), F.when(F.col("room_id") % 11 == 0, " 無法回答").otherwise("")).alias("response"))
    return ask.join(got, ["room_id", "turn"]).select((F.col("room_id") * 1000 + F.col("turn")).alias("id"), "question", "response", (F.length("response") / 100).alias("seconds"), F.element_at(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard")), (F.col("room_id") % 3 + 1).cast("int")).alias("difficulty"))


_CAT = " + ".join("({s})::INTEGER".format(s=" OR ".join(f"contains({{0}}, '{w}')" for w in words)) for words in evaluate.CATEGORIES.values())
_MET = " + ".join("(({q}) AND ({r}))::INTEGER".format(q=" OR ".join(f"contains(lower(question), '{w}')" for w in words), r=" OR ".join(f"contains(lower(response), '{w}')" for w in words)) for words in evaluate.CATEGORIES.values())
ANSWERS = f"""a AS (SELECT u.room_id * 1000 + u.turn + 1 AS id, u.content || ' 年度 %' AS question, g.content || CASE WHEN g.turn % 3 = 0 THEN '年 12%' ELSE '' END || CASE WHEN g.room_id % 11 = 0 THEN ' 無法回答' ELSE '' END AS response, u.room_id
  FROM ({M}) u JOIN ({M}) g ON g.room_id = u.room_id AND g.turn = u.turn + 1 WHERE u.role = 'user' AND g.role = 'assistant'),
b AS (SELECT *, regexp_matches(lower(response), '{evaluate.ERROR_WORDS}') AS has_error, length(response) / 100.0::DOUBLE AS seconds, ['easy', 'medium', 'hard'][(room_id % 3 + 1)::INTEGER] AS difficulty, length(response)::INTEGER AS response_length, ({_CAT.format('lower(question)')}) AS total_keywords, ({_MET}) AS matched_keywords FROM a),
c AS (SELECT *, round(matched_keywords::DOUBLE / greatest(total_keywords, 1), 6) AS relevance FROM b),
e AS (SELECT *, round(least(10.0::DOUBLE, CASE WHEN has_error THEN 0 ELSE 3 END + CASE WHEN response_length BETWEEN 50 AND 1000 THEN 2 WHEN response_length > 1000 THEN 1 ELSE 0 END + 3 * relevance
  + (regexp_matches(response, '[0-9]') OR contains(response, '%'))::INTEGER + 0.5::DOUBLE * regexp_matches(response, '{evaluate.CJK_DIGITS}')::INTEGER), 6) AS quality FROM c)"""
_SUMMARY = "count(*) AS total, round(avg(quality), 6) AS avg_quality, min(quality) AS min_quality, max(quality) AS max_quality, round(avg(seconds), 6) AS avg_seconds, round(100 * avg(CASE WHEN has_error THEN 0.0 ELSE 1.0 END), 6)::DOUBLE AS success_percent, round(avg(response_length), 6) AS avg_length, round(avg(relevance), 6) AS avg_relevance"


def quality_scores(spark, sf_dir):
    return evaluate.quality(_answers(spark, sf_dir)).select("id", "total_keywords", "matched_keywords", "relevance", "quality")


def quality_summary(spark, sf_dir):
    return evaluate.summary(evaluate.quality(_answers(spark, sf_dir)))


def quality_by_difficulty(spark, sf_dir):
    return evaluate.summary(evaluate.quality(_answers(spark, sf_dir)), "difficulty")


def quality_extremes(spark, sf_dir):
    return evaluate.extremes(evaluate.quality(_answers(spark, sf_dir)))


def train_pairs_pos(spark, sf_dir):
    return evaluate.page_pairs(views.pages(spark, sf_dir)).select("doc_id", "page", "label", F.md5(F.concat_ws("|", "text1", "text2").cast("binary")).alias("digest"))


def train_pairs_neg(spark, sf_dir):
    return evaluate.negative_pairs(_docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"))


def train_split(spark, sf_dir):
    return evaluate.split_80_20(_docs(spark, sf_dir).select("doc_id"), "doc_id")


def qa_patterns(spark, sf_dir):
    """Question and answer marks put around turns, and found again."""
    own = views.messages(spark, sf_dir)
    talk = own.groupBy("room_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.when(F.col("role") == "user", F.concat(F.lit("問: "), F.col("content"))).otherwise(F.concat(F.lit("答: "), F.col("content"))).alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return talk.select("room_id", F.inline(text.qa_pairs(F.col("text"))))


def random_suggestions(spark, sf_dir):
    """The first k in the order of a hash with a seed."""
    own = _docs(spark, sf_dir).select("doc_id", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("|7")).cast("binary")).alias("h"))
    return own.orderBy("h", "doc_id").limit(10).select("doc_id")


_SENT = "list_filter(list_transform(string_split(regexp_replace(translate(text, '.!?;', '。！？；'), '([。！？；…])', concat(chr(92) || '1', chr(1)), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '')"
_SENT = _SENT.replace("concat(chr(92) || '1', chr(1))", "'\\1' || chr(1)")
_DROP = "list_filter(list_transform(string_split_regex(translate(text, '.!?;', '。！？；'), '[。！？；]'), lambda x: trim(x, ' ')), lambda x: x <> '')"


def _windows(size: int, step: int, last: str) -> str:
    return f"SELECT doc_id, win::INTEGER AS win, md5(substr(text, (win * {step} + 1)::BIGINT, {size})) AS digest FROM (SELECT doc_id, text, unnest(generate_series(0, {last})) AS win FROM documents WHERE length(text) > 0)"


QUERIES = {
    "doc_ids": (doc_ids, "SELECT DISTINCT source FROM documents WHERE source <> '' AND text IS NOT NULL"),
    "valid_nodes": (valid_nodes, f"SELECT lang, count(*) AS nodes, count(DISTINCT doc_id) AS docs FROM ({P}) WHERE trim(text) <> '' GROUP BY lang"),
    "node_type_stats": (node_type_stats, f"SELECT lang, count(*) AS n, round(avg(length(text)), 6) AS avg_chars FROM ({P}) GROUP BY lang"),
    "node_routing": (node_routing, f"SELECT type, CASE type WHEN 'paragraph' THEN 'chunk' WHEN 'table_summary' THEN 'table' ELSE 'pass' END AS route, count(*) AS n FROM ({views.POINTS}) GROUP BY type"),
    "chunk_ids": (chunk_ids, f"SELECT doc_id, page, id FROM ({CHUNKS})"),
    "hashes": (hashes, r"SELECT doc_id, 'temp_' || md5(doc_id::VARCHAR || '|1|paragraph|' || substr(text, 1, 64)) AS temp_id, substr(sha1(doc_id::VARCHAR || chr(30) || lang || chr(30)), 1, 16) AS part_hash, substr(sha1(trim(regexp_replace(regexp_replace(text, '[^\x00-\x7f]', '?', 'g'), '\s+', ' ', 'g'), ' ')), 1, 12) AS text_hash FROM documents"),
    "text_hash_dedup": (text_hash_dedup, rf"SELECT substr(sha1(trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')), 1, 12) AS h, count(*) AS copies, min(doc_id) AS first_doc FROM ({P}) WHERE trim(text) <> '' GROUP BY 1"),
    "sentence_split": (sentence_split, f"SELECT doc_id, len(s)::INTEGER AS sentences, md5(array_to_string(s, chr(1))) AS digest FROM (SELECT doc_id, {_SENT} AS s FROM documents)"),
    "paragraph_split": (paragraph_split, "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))::INTEGER AS paragraphs FROM documents"),
    "resentenced": (resentenced, f"SELECT doc_id, md5(t) AS digest, length(t)::INTEGER AS chars FROM (SELECT doc_id, array_to_string(s, '。') || CASE WHEN len(s) > 0 AND regexp_matches(text, '[.!?;。！？；]') THEN '。' ELSE '' END AS t FROM (SELECT doc_id, text, {_DROP} AS s FROM documents))"),
    "normalize_compare": (normalize_compare, r"SELECT doc_id, md5(lower(trim(replace(regexp_replace(regexp_replace(text, '[^\x00-\x7f]', '?', 'g'), '\s+', ' ', 'g'), '|', '｜'), ' '))) AS digest, length(regexp_replace(text, '[\s　]+', '', 'g'))::INTEGER AS dense_chars FROM documents"),
    "char_windows_1200": (char_windows_1200, _windows(1200, 1050, "CASE WHEN length(text) <= 1200 THEN 0 ELSE ceil((length(text) - 1200) / 1050.0)::BIGINT END")),
    "char_windows_2000": (char_windows_2000, _windows(2000, 1800, "((length(text) - 1) // 1800)::BIGINT")),
    "unseen_windows": (unseen_windows, None),
    "token_chunks": (token_chunks, None),
    "table_chunks": (table_chunks, None),
    "html_cells": (html_cells, None),
    "html_records": (html_records, """WITH o AS (SELECT o_custkey, o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS s FROM orders),
      r AS (SELECT *, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INTEGER AS i, min(s) OVER w AS lo, max(s) OVER w AS hi FROM o WINDOW w AS (PARTITION BY o_custkey))
      SELECT o_custkey AS page_id, 0::INTEGER AS table_idx, i AS row_idx, c::INTEGER AS col_idx, ['Customer', 'Order', 'Status', 'Priority'][c + 1] AS header,
      CASE c WHEN 0 THEN 'C' || o_custkey::VARCHAR WHEN 1 THEN o_orderkey::VARCHAR WHEN 2 THEN coalesce(s, CASE WHEN lo = hi THEN lo END, '') ELSE o_orderpriority END AS val, false AS is_note FROM r, range(4) t(c)
      UNION ALL SELECT DISTINCT o_custkey, 0, 0, 0, 'Note', 'Orders of one customer by their key', true FROM orders"""),
    "parse_constraints": (parse_constraints, None),
    "clean_query": (clean_query, None),
    "file_names": (file_names, r"SELECT doc_id, (doc_id % 100)::INTEGER AS page, (doc_id % 50)::INTEGER AS table_no, 'Report_' || doc_id::VARCHAR || '_table' || (doc_id % 50)::VARCHAR || '_p0' || (doc_id % 100)::VARCHAR || '.html' AS safe, 'Report ' || doc_id::VARCHAR || '_table' || (doc_id % 50)::VARCHAR || '_p0' || (doc_id % 100)::VARCHAR AS stem FROM documents"),
    "cell_numbers": (cell_numbers, rf"""SELECT table_id, row_idx, col_idx, coalesce(regexp_matches(v, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'), false) AS is_number, CASE WHEN regexp_matches(v, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN v::DOUBLE END AS num,
      CASE WHEN regexp_matches(val, '^-?[0-9]{{1,3}}(,[0-9]{{3}})*(\.[0-9]+)?$') THEN replace(val, ',', '')::DOUBLE END AS strict, coalesce(regexp_matches(val, '^[0-9,.%]+$'), false) AS pure, coalesce(regexp_matches(val, '^[\s()+\-0-9.,%]*[0-9][\s()+\-0-9.,%]*$'), false) AS looks
      FROM (SELECT *, regexp_replace(regexp_replace(val, '[,\s]', '', 'g'), '[%元萬億千]+$', '') AS v FROM ({views.RECORDS}))"""),
    "summary_plan": (summary_plan, "SELECT doc_id, CASE WHEN length(text) > 6000 THEN round((length(text) // 1800) * 0.075::DOUBLE, 6) END AS refused_minutes, CASE WHEN length(text) // 4 > 600 THEN 'chunked' ELSE 'direct' END AS strategy, CASE WHEN strlen(text) > 5242880 THEN 'large' WHEN strlen(text) > 1048576 THEN 'medium' ELSE 'small' END AS size FROM documents"),
    "compression": (compression, f"""WITH s AS (SELECT table_id, sum(length(text))::BIGINT AS summary_chars FROM ({TABLE_SUMMARIES}) GROUP BY table_id), c AS (SELECT table_id, sum(length(val))::BIGINT AS chars FROM ({views.RECORDS}) GROUP BY table_id)
      SELECT table_id, chars, summary_chars, round(summary_chars::DOUBLE / chars, 6) AS ratio FROM c JOIN s USING (table_id)"""),
    "truncations": (truncations, None),
    "header_footer_lines": (header_footer_lines, f"""WITH p AS ({P}), f AS (SELECT source AS doc_id, text FROM (SELECT *, max(page) OVER (PARTITION BY doc_id) AS last FROM p) WHERE page = 1 OR page = last
        UNION ALL SELECT source, 'Report of ' || source FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT source, 'Confidential' FROM documents WHERE doc_id % 2 = 0),
      s AS (SELECT source AS doc_id, count(DISTINCT doc_id) AS pages FROM documents GROUP BY source)
      SELECT f.doc_id, trim(text, ' ') AS text, count(*) AS n FROM f JOIN s ON s.doc_id = f.doc_id WHERE trim(text, ' ') <> '' GROUP BY f.doc_id, 2, pages HAVING count(*) >= greatest(2, floor(0.7::DOUBLE * pages))"""),
    "strip_headers": (strip_headers, rf"""WITH p AS ({P}), r AS (SELECT doc_id, trim(text, ' ') AS t FROM p WHERE trim(text, ' ') <> '' GROUP BY 1, 2 HAVING count(*) >= 2)
      SELECT doc_id, md5(trim(regexp_replace(string_agg(text, ' ' ORDER BY page), '\s+', ' ', 'g'), ' ')) AS digest FROM p WHERE (doc_id, trim(text, ' ')) NOT IN (SELECT (doc_id, t) FROM r) GROUP BY doc_id"""),
    "bbox_mask": (bbox_mask, """WITH p AS (SELECT p_partkey, p_brand AS doc_id, p_size % 5 AS page, (p_partkey % 100)::DOUBLE AS x0, (p_partkey % 37)::DOUBLE AS y0, p_size FROM part)
      SELECT p_partkey, doc_id, page FROM p WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.p_size > 40 AND b.doc_id = p.doc_id AND b.page = p.page AND p.x0 <= b.x0 + 15 AND b.x0 <= p.x0 + 3 AND p.y0 <= b.y0 + 15 AND b.y0 <= p.y0 + 3)"""),
    "recent_messages": (recent_messages, f"SELECT room_id, msg_id, role, row_number() OVER (PARTITION BY room_id ORDER BY ts, msg_id)::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY room_id ORDER BY ts DESC, msg_id DESC) AS n FROM ({M})) WHERE n <= 3"),
    "last_answers": (last_answers, f"SELECT room_id, coalesce(arg_max(content, (ts, msg_id)) FILTER (WHERE role = 'assistant'), 'no answer') AS content FROM ({M}) GROUP BY room_id"),
    "room_stats": (room_stats, f"SELECT room_id, count(*) AS message_count, epoch(max(ts))::BIGINT AS updated_at, epoch(min(ts))::BIGINT AS created_at FROM ({M}) GROUP BY room_id"),
    "recent_rooms": (recent_rooms, f"SELECT room_id, count(*) AS message_count, epoch(max(ts))::BIGINT AS updated_at FROM ({M}) GROUP BY room_id ORDER BY updated_at DESC, room_id LIMIT 10"),
    "time_decay_search": (time_decay_search, f"SELECT * FROM (SELECT query_id, id, final, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, id)::INTEGER AS place FROM (SELECT query_id, id, round(0.7 * score + 0.3 * exp(-((1706745600 - (1704067200 + id * 3600)) / 86400.0::DOUBLE) * ln(2) / 3.0), 6) AS final FROM ({_topk(20)}))) WHERE place <= 10"),
    "chat_context": (chat_context, f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY room_id ORDER BY ts DESC, msg_id DESC) AS n FROM ({M})), c AS (SELECT room_id, string_agg(role || ': ' || substr(content, 1, 200), chr(10) ORDER BY ts, msg_id) AS context FROM n WHERE n <= 10 GROUP BY room_id)
      SELECT room_id, md5(context) AS digest, length(context)::INTEGER AS chars FROM c"""),
    "doc_context": (doc_context, f"SELECT doc_id, md5(string_agg(substr(text, 1, 200), chr(10) ORDER BY page)) AS digest FROM ({P}) WHERE page <= 10 AND trim(text, ' ') <> '' GROUP BY doc_id"),
    "context_block": (context_block, None),
    "relevance_gate": (relevance_gate, f"SELECT query_id, max(score - 0.95) >= 0.1 AS answerable FROM ({_topk(12)}) h JOIN documents d ON d.doc_id = h.id GROUP BY query_id"),
    "room_delete": (room_delete, f"SELECT room_id, msg_id FROM ({M}) WHERE room_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')"),
    "upsert_points": (upsert_points, f"WITH o AS (SELECT id, doc_id, page FROM ({views.POINTS})), n AS (SELECT id + 3 AS id, doc_id || 'x' AS doc_id, page FROM o WHERE page >= 5) SELECT * FROM n UNION ALL SELECT * FROM o WHERE id NOT IN (SELECT id FROM n)"),
    "merge_observations": (merge_observations, "WITH o AS (SELECT p_partkey AS k, p_name AS name, p_size AS size FROM part WHERE p_size <= 30), n AS (SELECT p_partkey AS k, upper(p_name) AS name, p_size + 100 AS size FROM part WHERE p_size >= 20) SELECT k, coalesce(o.name, n.name) AS name, coalesce(n.size, o.size) AS size FROM o FULL JOIN n USING (k)"),
    "set_payload": (set_payload, "SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN s_nationkey + 50 ELSE s_nationkey END AS popularity FROM supplier"),
    "ensure_rooms": (ensure_rooms, "SELECT DISTINCT conv_id AS room_id, false AS made FROM conversations UNION ALL SELECT s_suppkey, true FROM supplier WHERE s_suppkey NOT IN (SELECT conv_id FROM conversations)"),
    "task_stats": (task_stats, f"SELECT status, count(*) AS n, round(avg(value), 4) AS avg_value FROM ({T}) GROUP BY status"),
    "newest_tasks": (newest_tasks, f"SELECT task_id, owner, status FROM ({T}) WHERE status = 'completed' ORDER BY started_at DESC, task_id DESC LIMIT 20"),
    "task_progress": (task_progress, f"SELECT owner, floor(100.0 * done / total)::BIGINT AS percent, CASE WHEN done > 0 THEN floor(elapsed::DOUBLE * (total - done) / done)::BIGINT END AS eta_seconds FROM (SELECT owner, count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS done, floor(epoch(max(started_at)))::BIGINT - floor(epoch(min(started_at)))::BIGINT AS elapsed FROM ({T}) GROUP BY owner)"),
    "system_status": (system_status, "SELECT store, rows, CASE WHEN rows > 0 THEN 'healthy' ELSE 'degraded' END AS health FROM (SELECT 'documents' AS store, count(*) AS rows FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'conversations', count(*) FROM conversations)"),
    "quality_scores": (quality_scores, f"WITH {ANSWERS} SELECT id, total_keywords::INTEGER AS total_keywords, matched_keywords::INTEGER AS matched_keywords, relevance, quality FROM e"),
    "quality_summary": (quality_summary, f"WITH {ANSWERS} SELECT {_SUMMARY} FROM e"),
    "quality_by_difficulty": (quality_by_difficulty, f"WITH {ANSWERS} SELECT difficulty, {_SUMMARY} FROM e GROUP BY difficulty"),
    "quality_extremes": (quality_extremes, f"WITH {ANSWERS}, k AS (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, row_number() OVER (ORDER BY {o}, id)::INTEGER AS place, id FROM e" for k, o in (("best", "quality DESC"), ("worst", "quality"), ("fastest", "seconds"), ("slowest", "seconds DESC"))) + ") SELECT * FROM k WHERE place <= 5"),
    "train_pairs_pos": (train_pairs_pos, f"SELECT doc_id, page, 0.9::DOUBLE AS label, md5(text || '|' || nxt) AS digest FROM (SELECT *, lead(text) OVER (PARTITION BY doc_id ORDER BY page) AS nxt FROM ({P}) WHERE length(trim(text, ' ')) > 0) WHERE nxt IS NOT NULL"),
    "train_pairs_neg": (train_pairs_neg, "WITH h AS (SELECT doc_id AS id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR), doc_id) AS n FROM documents), m AS (SELECT least(100, count(*) // 2) AS n FROM documents) SELECT a.id AS id1, b.id AS id2, 0.1::DOUBLE AS label FROM h a JOIN h b ON b.n = a.n + 1, m WHERE a.n % 2 = 1 AND b.n <= 2 * m.n"),
    "train_split": (train_split, "SELECT doc_id, CASE WHEN ('0x' || substr(md5(doc_id::VARCHAR), 1, 4))::INTEGER % 10 < 8 THEN 'train' ELSE 'valid' END AS part FROM documents"),
    "qa_patterns": (qa_patterns, None),
    "random_suggestions": (random_suggestions, "SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || '|7'), doc_id LIMIT 10"),
}
