"""Graph and table queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.operators import graph, tables
from docquarry.plans import views
from docquarry.plans.shared_folder import cut_lineage

E, R = views.EDGES, views.RECORDS
SEEDS = "SELECT 'r' || r_regionkey::VARCHAR AS id FROM region"
ALLOWED = "(" + ", ".join(f"'{r}'" for r in graph.ALLOWED_RELATIONS) + ")"
UNDIRECTED = f"SELECT eid, src AS a, dst AS b, rel FROM ({E}) UNION ALL SELECT eid, dst, src, rel FROM ({E})"
WEIGHT = "CASE rel WHEN 'OPERATES_IN' THEN 0.2 WHEN 'REPORTED' THEN 0.3 WHEN 'HAS_CHUNK' THEN 0.05 ELSE 0.1 END::DOUBLE"


def _seeds(spark, sf_dir):
    return views.table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"))


def rel_types(spark, sf_dir):
    return graph.relation_types(views.edges(spark, sf_dir))


def allowed_rels(spark, sf_dir):
    return graph.allowed_types(views.edges(spark, sf_dir))


def rel_frequency(spark, sf_dir):
    return graph.relation_frequency(views.edges(spark, sf_dir), _seeds(spark, sf_dir))


def entity_counts(spark, sf_dir):
    return graph.entity_counts(views.edges(spark, sf_dir))


def _khop(hops):
    def khop(spark, sf_dir):
        return graph.expand(views.edges(spark, sf_dir), _seeds(spark, sf_dir), hops, 15, chunk_prefix="src")

    sql = f"""WITH RECURSIVE u AS (SELECT *, {WEIGHT} AS w FROM ({UNDIRECTED})),
    p AS (SELECT id AS seed, id AS node, []::BIGINT[] AS used, 0.0::DOUBLE AS bonus, 0 AS hop FROM ({SEEDS})
      UNION ALL SELECT p.seed, u.b, list_append(p.used, u.eid), p.bonus + u.w, hop + 1 FROM p JOIN u ON u.a = p.node WHERE hop < {hops} AND NOT list_contains(p.used, u.eid)),
    c AS (SELECT seed, CASE WHEN regexp_matches(node, '^src[0-9]+$') THEN node ELSE seed END AS chunk, round(max(bonus), 6) AS bonus FROM p WHERE hop > 0 GROUP BY 1, 2)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY bonus DESC, chunk)::INTEGER AS rank FROM c) WHERE rank <= 15"""
    return khop, sql


def khop_relaxed(spark, sf_dir):
    return graph.relaxed_relations(views.edges(spark, sf_dir), _seeds(spark, sf_dir), ["SUBSIDIARY_OF"])


RELAXED = f"""WITH u AS ({UNDIRECTED}), s AS (SELECT * FROM u WHERE a IN (SELECT id FROM ({SEEDS}))),
p AS (SELECT rel FROM s UNION ALL SELECT s.rel FROM s JOIN u ON u.a = s.b AND u.eid <> s.eid)
SELECT rel FROM p GROUP BY rel ORDER BY count(*) DESC, rel LIMIT 10"""


def temporary_seeds(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents")
    chunks = docs.select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("doc_id"))
    hits = views.points(spark, sf_dir).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("id"), F.concat(F.lit("src"), F.col("page").cast("string")).alias("doc_id"), F.col("id").alias("rank"))
    return graph.with_temporary_seeds(views.edges(spark, sf_dir), hits, chunks).where("eid < 0").select("src", "dst", "rel")


TEMP = f"""WITH h AS (SELECT 'p' || id::VARCHAR AS id, 'src' || page::VARCHAR AS doc_id, id AS rank FROM ({views.POINTS}) ORDER BY rank LIMIT 3)
SELECT 'temp_' || id AS src, doc_id AS dst, 'HAS_CHUNK' AS rel FROM h
UNION ALL SELECT 'temp_' || h.id, 'c' || d.doc_id::VARCHAR, 'RELATED_TO' FROM h JOIN documents d ON d.source = h.doc_id"""


def graph_communities(spark, sf_dir):
    return graph.communities(views.edges(spark, sf_dir), cut_lineage)


COMMUNITIES = f"""WITH RECURSIVE u AS (SELECT DISTINCT a, b FROM ({UNDIRECTED})),
r AS (SELECT DISTINCT a AS id, a AS seen FROM u UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.seen)
SELECT id, min(seen) AS community FROM r GROUP BY id"""


def document_star(spark, sf_dir):
    return graph.star(views.chunks(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), "id"))


CHUNK_ID = "(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12))"
CHUNKS = f"SELECT doc_id, page, text, lang, source, {CHUNK_ID} AS id FROM (SELECT *, md5(doc_id::VARCHAR || '|' || page::VARCHAR || '|paragraph|0|' || substr(text, 1, 64)) AS h FROM ({views.PAGES}))"


def label_sanitize(spark, sf_dir):
    parts = views.table(spark, sf_dir, "part")
    return graph.sanitized(parts.select(F.col("p_brand").alias("src"), F.col("p_type").alias("rel"), F.col("p_name").alias("dst")))


def _cells(spark, sf_dir):
    return views.records(spark, sf_dir)


def _obs(spark, sf_dir):
    return tables.observations(_cells(spark, sf_dir))


NUM = r"regexp_matches(regexp_replace(regexp_replace(val, '[,\s]', '', 'g'), '[%元萬億千]+$', ''), '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$')"
VALUE = f"CASE WHEN {NUM} THEN regexp_replace(regexp_replace(val, '[,\\s]', '', 'g'), '[%元萬億千]+$', '')::DOUBLE END"
HASH = "md5(doc_id || '|' || table_id || '|' || row_idx::VARCHAR || '|' || col_idx::VARCHAR || '|' || col || '|' || val)"
OBS = f"""c AS (SELECT *, {VALUE} AS value_num, {HASH} AS source_hash FROM ({R}) WHERE val IS NOT NULL AND trim(val) <> ''),
pan AS (SELECT doc_id, table_id, row_idx, trim(regexp_replace(arg_min(val, col_idx), '\\s*\\(.*?\\)\\s*', '', 'g')) AS panel FROM c WHERE value_num IS NULL GROUP BY ALL)"""


def observations(spark, sf_dir):
    return _obs(spark, sf_dir).select("doc_id", "table_id", "row_idx", "col_idx", "metric_leaf", F.size("dimensions").alias("dims"), "value_raw", "value_num", "panel", "aggregate", "source_hash")


OBSERVATIONS = f"""WITH {OBS} SELECT c.doc_id, c.table_id, c.row_idx, col_idx, col AS metric_leaf,
  (SELECT count(*) FROM c o WHERE o.doc_id = c.doc_id AND o.table_id = c.table_id AND o.row_idx = c.row_idx AND o.value_num IS NULL AND o.col_idx <> c.col_idx)::INTEGER AS dims,
  val AS value_raw, value_num, coalesce(panel, '') AS panel, false AS aggregate, source_hash
  FROM c LEFT JOIN pan ON pan.doc_id = c.doc_id AND pan.table_id = c.table_id AND pan.row_idx = c.row_idx"""
DIMS = f"{OBS}, dims AS (SELECT c.source_hash, c.doc_id, c.table_id, o.col AS k, o.val AS v FROM c JOIN c o ON o.doc_id = c.doc_id AND o.table_id = c.table_id AND o.row_idx = c.row_idx AND o.col_idx <> c.col_idx WHERE o.value_num IS NULL)"


def numeric_density(spark, sf_dir):
    return tables.numeric_density(_cells(spark, sf_dir))


def kg_summary(spark, sf_dir):
    return tables.kg_summary(_obs(spark, sf_dir))


def row_texts(spark, sf_dir):
    return tables.row_texts(_cells(spark, sf_dir))


def table_texts(spark, sf_dir):
    return tables.table_texts(_obs(spark, sf_dir))


def row_cap(spark, sf_dir):
    rows = _cells(spark, sf_dir).select("doc_id", "table_id", "row_idx").distinct().withColumn("aggregate", F.col("row_idx") % 97 == 0)
    return tables.capped_rows(rows, 20)


def column_texts(spark, sf_dir):
    return tables.column_texts(_cells(spark, sf_dir))


def table_summaries(spark, sf_dir):
    return tables.summaries(_cells(spark, sf_dir))


def table_nodes(spark, sf_dir):
    return tables.nodes(_cells(spark, sf_dir)).groupBy("table_id", "type").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def cube_vertices(spark, sf_dir):
    return graph.cube_vertices(_obs(spark, sf_dir))


def cube_edges(spark, sf_dir):
    return graph.cube_edges(_obs(spark, sf_dir))


def linked_rows(spark, sf_dir):
    rows = _cells(spark, sf_dir).select("doc_id", "table_id", "row_idx").distinct().withColumn("id", F.concat_ws("#", "doc_id", "table_id", F.col("row_idx").cast("string")))
    return graph.linked_rows(rows, _obs(spark, sf_dir))


def constant_fill(spark, sf_dir):
    return tables.constant_columns(_cells(spark, sf_dir).withColumn("val", F.when(F.col("row_idx") % 3 == 0, "").otherwise(F.col("val"))))


def modal_label(spark, sf_dir):
    return tables.modal_first_column(_cells(spark, sf_dir))


def header_rows(spark, sf_dir):
    """Rows of each table before its first number, by first letters of cells."""
    return tables.header_rows(_cells(spark, sf_dir)).groupBy("doc_id", "table_id").agg(F.count_if("is_header").alias("header_cells"), F.count("*").alias("cells"))


def note_rows(spark, sf_dir):
    cells = _cells(spark, sf_dir).withColumn("val", F.when((F.col("row_idx") % 5 == 0) & (F.col("col_idx") > 0), "").otherwise(F.col("val")))
    return tables.split_notes(cells).where("is_note").select("doc_id", "table_id", "row_idx").distinct()


def header_names(spark, sf_dir):
    """Types of parts as headers, every third blank: filled from the left, repeats numbered."""
    parts = views.table(spark, sf_dir, "part")
    heads = parts.select(F.col("p_brand").alias("table_id"), F.col("p_partkey").alias("col_idx"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_type")).alias("header"))
    return tables.filled_headers(heads)


HEADS = "SELECT p_brand AS table_id, p_partkey AS col_idx, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS header FROM part"


def collapsed_headers(spark, sf_dir):
    parts = views.table(spark, sf_dir, "part")
    return tables.collapsed_headers(parts.select(F.col("p_brand").alias("table_id"), F.col("p_partkey").alias("row_idx"), (F.col("p_size") % 5).alias("col_idx"), F.split("p_type", " ")[0].alias("header")))


def text_grids(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return tables.grid_of_text(docs).groupBy("id").agg(F.count("*").alias("cells"), F.max("row_idx").alias("last_row"), F.max("col_idx").alias("last_col"))


GRIDS = """WITH l AS (SELECT doc_id AS id, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS row_idx, unnest(string_split(text, chr(10))) AS line,
  CASE WHEN contains(string_split(text, chr(10))[1], chr(9)) THEN chr(9) WHEN contains(string_split(text, chr(10))[1], '|') THEN '|' WHEN contains(string_split(text, chr(10))[1], ',') THEN ',' WHEN contains(string_split(text, chr(10))[1], ';') THEN ';' ELSE chr(9) END AS d FROM documents)
SELECT id, sum(len(string_split(line, d)))::BIGINT AS cells, max(row_idx)::INTEGER AS last_row, (max(len(string_split(line, d))) - 1)::INTEGER AS last_col FROM l WHERE trim(line) <> '' GROUP BY id"""


def table_detections(spark, sf_dir):
    parts = views.table(spark, sf_dir, "part")
    return tables.detections(parts.select(F.col("p_brand").alias("doc_id"), F.col("p_size").alias("page"), F.col("p_partkey").alias("ord"), (F.col("p_retailprice") % 100).alias("accuracy"))).select("doc_id", "page", "ord", "table_no")


def largest_candidate(spark, sf_dir):
    parts = views.table(spark, sf_dir, "part")
    return tables.largest_candidate(parts.select(F.col("p_brand").alias("key"), F.col("p_partkey").alias("candidate"), F.col("p_size").alias("rows")))


TABLE_SUMMARIES = f"SELECT doc_id, table_id, '表格 ' || table_id || '，包含 ' || count(DISTINCT col)::VARCHAR || ' 欄位: ' || array_to_string(list_transform(list_sort(list(DISTINCT (col_idx, col))), lambda x: x[2]), ', ') || '，共 ' || count(DISTINCT row_idx)::VARCHAR || ' 筆記錄。' AS text FROM ({R}) GROUP BY doc_id, table_id"
_K1, _K2, _K3 = _khop(1), _khop(2), _khop(3)
QUERIES = {
    "rel_types": (rel_types, f"SELECT DISTINCT rel FROM ({E})"),
    "allowed_rels": (allowed_rels, f"SELECT DISTINCT rel FROM ({E}) WHERE rel IN {ALLOWED}"),
    "rel_frequency": (rel_frequency, f"SELECT rel, count(*) AS n FROM ({UNDIRECTED}) WHERE a IN (SELECT id FROM ({SEEDS})) GROUP BY rel ORDER BY n DESC, rel LIMIT 10"),
    "entity_counts": (entity_counts, f"SELECT src, count(DISTINCT dst) AS entities, count(*) AS relations FROM ({E}) WHERE rel NOT IN ('HAS_CHUNK', 'HAS_DOCUMENT', 'HAS_ENTITY') GROUP BY src"),
    "khop1": _K1,
    "khop2": _K2,
    "khop3": _K3,
    "khop_relaxed": (khop_relaxed, RELAXED),
    "temporary_seeds": (temporary_seeds, TEMP),
    "graph_communities": (graph_communities, COMMUNITIES),
    "document_star": (document_star, f"SELECT DISTINCT doc_id::VARCHAR AS src, id AS dst, 'HAS_CHUNK' AS rel FROM ({CHUNKS})"),
    "label_sanitize": (label_sanitize, "SELECT substr(trim(p_brand), 1, 256) AS src, substr(trim(regexp_replace(upper(trim(p_type)), '[^A-Z0-9_]', '_', 'g'), '_'), 1, 64) AS rel, substr(trim(p_name), 1, 256) AS dst FROM part WHERE trim(p_brand) <> '' AND trim(p_name) <> ''"),
    "observations": (observations, OBSERVATIONS),
    "numeric_density": (numeric_density, f"SELECT doc_id, table_id, density, CASE WHEN density > 0.3 THEN 'fact_quant' ELSE 'generic' END AS kind, CASE WHEN density > 0.3 THEN 0.8 ELSE 0.6 END::DOUBLE AS confidence FROM (SELECT doc_id, table_id, round(avg(CASE WHEN {NUM} THEN 1.0 ELSE 0.0 END), 6) AS density FROM ({R}) WHERE trim(val) <> '' GROUP BY ALL)"),
    "kg_summary": (kg_summary, f"WITH {DIMS}, o AS (SELECT c.*, coalesce(panel, '') AS panel FROM c LEFT JOIN pan USING (doc_id, table_id, row_idx)) SELECT doc_id, table_id, count(*) AS observations, count(value_num) AS numbers, count(DISTINCT panel) AS panels, count(DISTINCT col) AS metrics, (SELECT count(DISTINCT k) FROM dims d WHERE d.doc_id = o.doc_id AND d.table_id = o.table_id) AS dimension_keys FROM o GROUP BY doc_id, table_id"),
    "row_texts": (row_texts, f"SELECT doc_id, table_id, row_idx, string_agg(col || ': ' || trim(val), ' | ' ORDER BY col_idx) FILTER (WHERE trim(val) <> '') AS text, count(*) FILTER (WHERE trim(val) <> '') AS value_count FROM ({R}) GROUP BY ALL"),
    "table_texts": (table_texts, f"""WITH {OBS}, o AS (SELECT c.*, coalesce(panel, '') AS panel FROM c LEFT JOIN pan USING (doc_id, table_id, row_idx))
      SELECT doc_id, table_id, substr(array_to_string(list_sort(list(DISTINCT panel)), ', ') || ' | ' || array_to_string(list_sort(list(DISTINCT col)), ', ') || ' | ' || array_to_string(list_slice(list(val ORDER BY row_idx, col_idx), 1, 3), ', '), 1, 400) AS text FROM o GROUP BY doc_id, table_id"""),
    "row_cap": (row_cap, f"SELECT doc_id, table_id, row_idx, aggregate FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, table_id ORDER BY aggregate DESC, row_idx) AS pos FROM (SELECT DISTINCT doc_id, table_id, row_idx, row_idx % 97 = 0 AS aggregate FROM ({R}))) WHERE pos <= 20 OR aggregate"),
    "column_texts": (column_texts, f"SELECT doc_id, table_id, col, col || ': ' || array_to_string(list_slice(v, 1, 10), ', ') || CASE WHEN len(v) > 10 THEN ' (+' || (len(v) - 10)::VARCHAR || ')' ELSE '' END AS text FROM (SELECT doc_id, table_id, col, list(val ORDER BY row_idx, val) AS v FROM ({R}) WHERE trim(val) <> '' GROUP BY ALL)"),
    "table_summaries": (table_summaries, TABLE_SUMMARIES),
    "table_nodes": (table_nodes, None),
    "cube_vertices": (cube_vertices, f"""WITH {DIMS} SELECT DISTINCT * FROM (SELECT doc_id AS id, 'Dataset' AS label FROM c UNION ALL SELECT doc_id || '#' || table_id, 'Table' FROM c UNION ALL SELECT col, 'Metric' FROM c UNION ALL SELECT source_hash, 'Observation' FROM c
      UNION ALL SELECT k, 'DimType' FROM dims UNION ALL SELECT k || '=' || v, 'DimVal' FROM dims)"""),
    "cube_edges": (cube_edges, f"""WITH {DIMS} SELECT DISTINCT * FROM (SELECT doc_id || '#' || table_id AS src, doc_id AS dst, 'IN_DATASET' AS rel FROM c UNION ALL SELECT source_hash, doc_id || '#' || table_id, 'IN_TABLE' FROM c UNION ALL SELECT source_hash, col, 'OF_METRIC' FROM c
      UNION ALL SELECT source_hash, k || '=' || v, 'FOR_DIM' FROM dims UNION ALL SELECT k || '=' || v, k, 'OF_TYPE' FROM dims)"""),
    "linked_rows": (linked_rows, f"WITH {OBS} SELECT doc_id || '#' || table_id || '#' || row_idx::VARCHAR AS src, source_hash AS dst, 'HAS_OBSERVATION' AS rel FROM c"),
    "constant_fill": (constant_fill, f"""WITH r AS (SELECT doc_id, table_id, row_idx, col_idx, col, nullif(trim(CASE WHEN row_idx % 3 = 0 THEN '' ELSE val END), '') AS v FROM ({R})), o AS (SELECT doc_id, table_id, col_idx, max(v) AS single FROM r GROUP BY ALL HAVING count(DISTINCT v) = 1)
      SELECT r.doc_id, r.table_id, r.row_idx, r.col_idx, r.col, coalesce(v, single, '') AS val FROM r LEFT JOIN o USING (doc_id, table_id, col_idx)"""),
    "modal_label": (modal_label, f"SELECT doc_id, table_id, arg_max(v, (n, -first)) AS label FROM (SELECT doc_id, table_id, val AS v, count(*) AS n, min(row_idx) AS first FROM ({R}) WHERE col_idx = 0 AND trim(val) <> '' GROUP BY ALL) GROUP BY doc_id, table_id"),
    "header_rows": (header_rows, f"""WITH r AS ({R}), h AS (SELECT doc_id, table_id, row_idx, max(regexp_matches(val, '^[0-9,.%]+$')::INTEGER) AS has FROM r GROUP BY ALL),
      b AS (SELECT *, sum(has) OVER (PARTITION BY doc_id, table_id ORDER BY row_idx) = 0 AS is_header FROM h) SELECT doc_id, table_id, count(*) FILTER (WHERE is_header) AS header_cells, count(*) AS cells FROM r JOIN b USING (doc_id, table_id, row_idx) GROUP BY doc_id, table_id"""),
    "note_rows": (note_rows, f"SELECT DISTINCT doc_id, table_id, row_idx FROM ({R}) WHERE row_idx % 5 = 0"),
    "header_names": (header_names, f"""WITH h AS ({HEADS}), f AS (SELECT table_id, col_idx, coalesce(last_value(nullif(trim(header), '') IGNORE NULLS) OVER (PARTITION BY table_id ORDER BY col_idx), '') AS header FROM h)
      SELECT table_id, col_idx, header, CASE WHEN n > 1 THEN header || '_' || n::VARCHAR ELSE header END AS name FROM (SELECT *, row_number() OVER (PARTITION BY table_id, header ORDER BY col_idx) AS n FROM f)"""),
    "collapsed_headers": (collapsed_headers, """WITH h AS (SELECT p_brand AS table_id, p_partkey AS row_idx, p_size % 5 AS col_idx, string_split(p_type, ' ')[1] AS header FROM part), k AS (SELECT *, lag(header) OVER (PARTITION BY table_id, col_idx ORDER BY row_idx) AS above FROM h)
      SELECT table_id, col_idx, string_agg(header, ' ' ORDER BY row_idx) AS header FROM k WHERE header <> '' AND (above IS NULL OR above <> header) GROUP BY table_id, col_idx"""),
    "text_grids": (text_grids, GRIDS),
    "table_detections": (table_detections, "SELECT doc_id, page, ord, row_number() OVER (PARTITION BY doc_id ORDER BY page, ord)::INTEGER AS table_no FROM (SELECT p_brand AS doc_id, p_size AS page, p_partkey AS ord FROM part WHERE p_retailprice % 100 >= 50)"),
    "largest_candidate": (largest_candidate, "SELECT key, candidate, rows FROM (SELECT p_brand AS key, p_partkey AS candidate, p_size AS rows, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS pos FROM part) WHERE pos = 1"),
}
