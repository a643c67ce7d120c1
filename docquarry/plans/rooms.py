"""Queries over rooms, tasks, contexts and seeds, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.functions import text
from docquarry.operators import rooms, search, tables
from docquarry.plans import views
from docquarry.plans.graphs import CHUNKS, TABLE_SUMMARIES
from docquarry.plans.retrieval import HITS, _hits

M, T, R, E = views.MESSAGES, views.TASKS, views.RECORDS, views.EDGES
ROOMS = f"SELECT room_id, min(ts) AS created_at, max(ts) AS updated_at, count(*) AS message_count FROM ({M}) GROUP BY room_id"
MARKED = f"SELECT DISTINCT room_id FROM ({M}) WHERE role = 'system'"


def _state(spark, sf_dir):
    messages = views.messages(spark, sf_dir)
    return rooms.created(messages), messages


def rooms_created(spark, sf_dir):
    own = _state(spark, sf_dir)[0]
    return own.select("room_id", F.unix_seconds("created_at").alias("created_at"), F.unix_seconds("updated_at").alias("updated_at"), "message_count")


def messages_appended(spark, sf_dir):
    """A closing message in each room, a message that comes again and a new room."""
    known, messages = _state(spark, sf_dir)
    closing = known.select("room_id", F.md5(F.concat(F.lit("end|"), F.col("room_id").cast("string")).cast("binary")).alias("msg_id"), F.lit("assistant").alias("role"), F.lit("bye").alias("content"), F.expr("updated_at + INTERVAL 1 MINUTE").alias("ts"), F.lit(-1).cast("long").alias("turn"))
    again = messages.where("turn = 0").select(closing.columns)
    opened = again.select((-F.col("room_id") - 1).alias("room_id"), F.md5(F.concat(F.lit("new|"), F.col("room_id").cast("string")).cast("binary")).alias("msg_id"), "role", "content", "ts", "turn")
    after, kept = rooms.appended(known, messages, closing.unionByName(again).unionByName(opened))
    counted = kept.groupBy("room_id").agg(F.count("*").alias("stored"))
    return after.join(counted, "room_id").select("room_id", F.unix_seconds("created_at").alias("created_at"), F.unix_seconds("updated_at").alias("updated_at"), "message_count", "stored")


def history_cleared(spark, sf_dir):
    """Rooms with a system message lose their history, not themselves."""
    known, messages = _state(spark, sf_dir)
    after, kept = rooms.cleared(known, messages, messages.where("role = 'system'"))
    stored = kept.groupBy("room_id").agg(F.count("*").alias("stored"))
    return after.join(stored, "room_id", "left").select("room_id", "message_count", F.coalesce("stored", F.lit(0)).cast("long").alias("stored"))


def room_lookup(spark, sf_dir):
    """All rooms and one that is not there; the cache holds those with a system message."""
    known, messages = _state(spark, sf_dir)
    cached = known.join(messages.where("role = 'system'").select("room_id").distinct(), "room_id", "left_semi")
    asked = known.select("room_id").unionByName(known.agg((F.max("room_id") + 1).alias("room_id")))
    return rooms.looked_up(asked, cached, known)


def tasks_completed(spark, sf_dir):
    """Tasks that a value is known of end: well if it is 50 or more."""
    tasks = views.tasks(spark, sf_dir)
    done = tasks.where("value is not null").select("task_id", (F.col("value") >= 50).alias("success"), F.when(F.col("value") >= 50, "indexed").otherwise("rejected").alias("message"))
    return rooms.completed_tasks(tasks, done)


def batch_counters(spark, sf_dir):
    return rooms.batch_counts(views.tasks(spark, sf_dir), "owner")


def answer_context(spark, sf_dir):
    """Queries whose best hit is of a table read more of their hits."""
    hits = _hits(spark, sf_dir)
    best = hits.groupBy("query_id").agg(F.max_by(F.struct("type"), F.struct("score", -F.col("id")))["type"].alias("top"))
    limits = best.select("query_id", rooms.context_limit(F.col("top").startswith("table"), F.lit(False)).alias("most"))
    return rooms.context(hits, limits).select("query_id", "id", "place")


def evidence_flat(spark, sf_dir):
    """Hits as flat rows: the fields that are shown, under their names in answers."""
    return _hits(spark, sf_dir).select("query_id", F.col("id").cast("string").alias("source_id"), F.col("doc_id").alias("file"), F.col("page").cast("string").alias("page"), F.round(F.col("score"), 3).alias("score"))


def public_messages(spark, sf_dir):
    """Messages without internal fields, renamed as clients know them."""
    return views.messages(spark, sf_dir).select(F.col("msg_id").alias("id"), "role", F.md5(F.col("content").cast("binary")).alias("digest"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))


def seed_fallback(spark, sf_dir):
    pages = views.pages(spark, sf_dir)
    hits = pages.select(F.concat_ws("#", F.col("doc_id").cast("string"), F.col("page").cast("string")).alias("hit"), "doc_id", "page", "text")
    return rooms.fallback_seeds(hits, views.chunks(spark, sf_dir))


def summary_include(spark, sf_dir):
    hits = search.preferring(_hits(spark, sf_dir), [""], 40).select("query_id", "id", "doc_id", "page", "type", "score", "rank")
    return search.table_evidence(hits, views.points(spark, sf_dir).drop("embedding"), 3).select("query_id", "id", "type", "score", "rank")


def table_lookup(spark, sf_dir):
    """Each table with its summary and its number of structured rows."""
    cells = views.records(spark, sf_dir)
    structured = cells.groupBy("doc_id", "table_id").agg(F.countDistinct("row_idx").alias("rows"))
    return structured.join(tables.summaries(cells), ["doc_id", "table_id"], "left").select("doc_id", "table_id", "rows", F.col("text").alias("summary"))


def record_sentences(spark, sf_dir):
    """Rows as ``key: value`` joined by the full stop of the script."""
    cells = views.records(spark, sf_dir).where("trim(val) <> ''")
    entries = F.transform(F.sort_array(F.collect_list(F.struct("col_idx", "col", "val"))), lambda x: F.struct(x["col"].alias("key"), x["val"].alias("value")))
    return cells.groupBy("doc_id", "table_id", "row_idx").agg(text.pairs_line(entries, "。").alias("text"))


def distinct_table_texts(spark, sf_dir):
    """Texts of rows and of cells of each table, equal ones once, with their number."""
    cells = views.records(spark, sf_dir)
    rows = tables.row_texts(cells).select("doc_id", "table_id", "text")
    both = rows.unionByName(cells.select("doc_id", "table_id", F.trim("val").alias("text"))).where("text <> ''").distinct()
    return both.groupBy("doc_id", "table_id").agg(F.count("*").alias("texts"), F.sum(F.length("text")).alias("chars"))


def graph_lines(spark, sf_dir):
    return rooms.graph_text(views.edges(spark, sf_dir))


QUERIES = {
    "rooms_created": (rooms_created, f"SELECT room_id, epoch(created_at)::BIGINT AS created_at, epoch(updated_at)::BIGINT AS updated_at, message_count FROM ({ROOMS})"),
    "messages_appended": (messages_appended, f"""WITH r AS ({ROOMS}), f AS (SELECT room_id, ts FROM ({M}) WHERE turn = 0)
      SELECT room_id, epoch(created_at)::BIGINT AS created_at, epoch(updated_at)::BIGINT + 60 AS updated_at, message_count + 1 AS message_count, message_count + 1 AS stored FROM r
      UNION ALL SELECT -room_id - 1, epoch(ts)::BIGINT, epoch(ts)::BIGINT, 1, 1 FROM f"""),
    "history_cleared": (history_cleared, f"SELECT room_id, CASE WHEN room_id IN ({MARKED}) THEN 0 ELSE message_count END::BIGINT AS message_count, CASE WHEN room_id IN ({MARKED}) THEN 0 ELSE message_count END::BIGINT AS stored FROM ({ROOMS})"),
    "room_lookup": (room_lookup, f"SELECT room_id, message_count, CASE WHEN room_id IN ({MARKED}) THEN 'cache' ELSE 'store' END AS origin FROM ({ROOMS}) UNION ALL SELECT max(room_id) + 1, NULL, NULL FROM ({ROOMS})"),
    "tasks_completed": (tasks_completed, f"""WITH t AS (SELECT *, status IN ('pending', 'processing') AND value IS NOT NULL AS ends, value >= 50 AS good FROM ({T}))
      SELECT task_id, CASE WHEN ends THEN CASE WHEN good THEN 'completed' ELSE 'failed' END ELSE status END AS status, CASE WHEN ends AND good OR status = 'completed' THEN 100 ELSE 0 END::INTEGER AS progress,
      CASE WHEN ends THEN CASE WHEN good THEN 'indexed' ELSE 'rejected' END END AS message FROM t"""),
    "batch_counters": (batch_counters, f"SELECT owner, count(*) FILTER (WHERE status = 'completed') AS ok, count(*) FILTER (WHERE status = 'failed') AS failed FROM ({T}) GROUP BY owner"),
    "answer_context": (answer_context, f"""WITH h AS ({HITS}), l AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS place FROM h),
      m AS (SELECT query_id, CASE WHEN type LIKE 'table%' THEN 25 ELSE 8 END AS most FROM l WHERE place = 1) SELECT l.query_id, id, place FROM l JOIN m USING (query_id) WHERE place <= most"""),
    "evidence_flat": (evidence_flat, f"SELECT query_id, id::VARCHAR AS source_id, doc_id AS file, page::VARCHAR AS page, round(score, 3) AS score FROM ({HITS})"),
    "public_messages": (public_messages, f"SELECT msg_id AS id, role, md5(content) AS digest, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp FROM ({M})"),
    "seed_fallback": (seed_fallback, f"""WITH c AS ({CHUNKS}), h AS (SELECT doc_id || '#' || page::VARCHAR AS hit, doc_id, page, substr(trim(text, ' '), 1, 100) AS start FROM ({views.PAGES}))
      SELECT hit, c.id FROM h JOIN c ON c.doc_id = h.doc_id AND c.page = h.page WHERE start <> '' AND contains(c.text, start)"""),
    "summary_include": (summary_include, f"""WITH h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM ({HITS})),
      g AS (SELECT query_id, doc_id, page, max(score) AS best, min(score) AS worst, max(rank) AS after FROM h WHERE type LIKE 'table%' GROUP BY ALL),
      n AS (SELECT g.query_id, p.id, p.type, best, worst, after, row_number() OVER (PARTITION BY g.query_id, p.doc_id, p.page, p.type ORDER BY p.id) AS pos FROM ({views.POINTS}) p JOIN g USING (doc_id, page)
        WHERE p.type LIKE 'table%' AND (g.query_id, p.id) NOT IN (SELECT (query_id, id) FROM h))
      SELECT query_id, id, type, CASE WHEN type = 'table_summary' THEN best ELSE worst END AS score, (after + pos)::INTEGER AS rank FROM n WHERE type = 'table_summary' OR pos <= 3"""),
    "table_lookup": (table_lookup, f"SELECT r.doc_id, r.table_id, r.rows, s.text AS summary FROM (SELECT doc_id, table_id, count(DISTINCT row_idx) AS rows FROM ({R}) GROUP BY ALL) r LEFT JOIN ({TABLE_SUMMARIES}) s USING (doc_id, table_id)"),
    "record_sentences": (record_sentences, f"SELECT doc_id, table_id, row_idx, string_agg(col || ': ' || trim(val), '。' ORDER BY col_idx) AS text FROM ({R}) WHERE trim(val) <> '' GROUP BY ALL"),
    "distinct_table_texts": (distinct_table_texts, f"""WITH t AS (SELECT doc_id, table_id, string_agg(col || ': ' || trim(val), ' | ' ORDER BY col_idx) FILTER (WHERE trim(val) <> '') AS text FROM ({R}) GROUP BY doc_id, table_id, row_idx UNION SELECT doc_id, table_id, trim(val) FROM ({R}))
      SELECT doc_id, table_id, count(*) AS texts, sum(length(text))::BIGINT AS chars FROM t WHERE text <> '' GROUP BY ALL"""),
    "graph_lines": (graph_lines, f"""WITH e AS ({E}), d AS (SELECT DISTINCT src, dst FROM e), l AS (SELECT DISTINCT src, rel FROM e)
      SELECT src AS id, src || ': ' || array_to_string(list_slice(list_sort(list(dst)), 1, 5), ', ') || ' (' || (SELECT array_to_string(list_slice(list_sort(list(rel)), 1, 3), ', ') FROM l WHERE l.src = d.src) || ')' AS text FROM d GROUP BY src"""),
}
