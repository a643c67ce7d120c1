"""The driver's tables seen as pages, chunks, points, messages, records and edges.

Each view has a DataFrame and the same thing as DuckDB SQL, for oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import ids


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as pages."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("pos", "text")).select("doc_id", (F.col("pos") + 1).alias("page"), "text", "lang", "source")


PAGES = "SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10)))))::INTEGER AS page, unnest(string_split(text, chr(10))) AS text, lang, source FROM documents"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as paragraph chunks with their ids."""
    own = pages(spark, sf_dir)
    return own.withColumn("id", ids.chunk_id(F.col("doc_id"), F.col("page"), F.lit("paragraph"), F.lit(0), F.col("text")))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as points of a vector collection."""
    kind = F.element_at(F.array(F.lit("paragraph"), F.lit("table_summary"), F.lit("table_row")), (F.col("vec_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("d"), F.col("label").cast("string")).alias("doc_id"), (F.col("vec_id") % 7).cast("int").alias("page"), kind.alias("type"), "embedding")


POINTS = "SELECT vec_id AS id, 'd' || label::VARCHAR AS doc_id, (vec_id % 7)::INTEGER AS page, ['paragraph', 'table_summary', 'table_row'][(vec_id % 3 + 1)::INTEGER] AS type, embedding::DOUBLE[] AS embedding FROM embeddings"


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100, as a query."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


VECTOR_QUERIES = "SELECT vec_id AS query_id, embedding::DOUBLE[] AS vector FROM embeddings WHERE vec_id % 100 = 0"


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as questions."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as messages of rooms, an hour and a minute apart."""
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    key = F.md5(F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string")).cast("binary"))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("room_id"), key.alias("msg_id"), "role", F.col("text").alias("content"), at.alias("ts"), "turn")


MESSAGES = "SELECT conv_id AS room_id, md5(conv_id::VARCHAR || '|' || turn::VARCHAR) AS msg_id, role, text AS content, make_timestamp((1704067200 + conv_id * 3600 + turn * 60)::BIGINT * 1000000) AS ts, turn FROM conversations"


def _money(column: str) -> Column:
    return F.col(column).cast("decimal(18,2)").cast("string")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of nation, supplier and part as cells of tables: (doc_id, table_id, row_idx, col_idx, col, val)."""

    def cells(name: str, doc: Column, key: str, columns: list[tuple[str, Column]]) -> DataFrame:
        pairs = F.array(*(F.struct(F.lit(i).alias("col_idx"), F.lit(c).alias("col"), v.alias("val")) for i, (c, v) in enumerate(columns)))
        return table(spark, sf_dir, name).select(doc.alias("doc_id"), F.lit(name).alias("table_id"), F.col(key).cast("long").alias("row_idx"), F.inline(pairs))

    text = lambda c: F.col(c).cast("string")
    nation = cells("nation", F.concat(F.lit("region"), text("n_regionkey")), "n_nationkey", [("name", F.col("n_name")), ("key", text("n_nationkey"))])
    supplier = cells("supplier", F.concat(F.lit("nation"), text("s_nationkey")), "s_suppkey", [("name", F.col("s_name")), ("balance", _money("s_acctbal"))])
    part = cells("part", F.col("p_brand"), "p_partkey", [("name", F.col("p_name")), ("type", F.col("p_type")), ("size", text("p_size")), ("price", _money("p_retailprice"))])
    return nation.unionByName(supplier).unionByName(part)


RECORDS = """
SELECT 'region' || n_regionkey::VARCHAR AS doc_id, 'nation' AS table_id, n_nationkey::BIGINT AS row_idx, unnest([0, 1]) AS col_idx, unnest(['name', 'key']) AS col, unnest([n_name, n_nationkey::VARCHAR]) AS val FROM nation
UNION ALL
SELECT 'nation' || s_nationkey::VARCHAR, 'supplier', s_suppkey::BIGINT, unnest([0, 1]), unnest(['name', 'balance']), unnest([s_name, s_acctbal::DECIMAL(18,2)::VARCHAR]) FROM supplier
UNION ALL
SELECT p_brand, 'part', p_partkey::BIGINT, unnest([0, 1, 2, 3]), unnest(['name', 'type', 'size', 'price']), unnest([p_name, p_type, p_size::VARCHAR, p_retailprice::DECIMAL(18,2)::VARCHAR]) FROM part
"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of nation, supplier and region as typed edges (eid, src, dst, rel), and documents as chunks of their source."""
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey").cast("long") * 10).alias("eid"), text("n", "n_nationkey").alias("src"), text("r", "n_regionkey").alias("dst"), F.lit("LOCATED_IN").alias("rel"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 10 + 1).alias("eid"), text("s", "s_suppkey").alias("src"), text("n", "s_nationkey").alias("dst"), F.lit("OPERATES_IN").alias("rel"))
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") * 10 + 2).alias("eid"), F.col("source").alias("src"), text("c", "doc_id").alias("dst"), F.lit("HAS_CHUNK").alias("rel"))
    j = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 10 + 3).alias("eid"), text("s", "s_suppkey").alias("src"), F.concat(F.lit("src"), (F.col("s_suppkey") % 20).cast("string")).alias("dst"), F.lit("REPORTED").alias("rel"))
    return n.unionByName(s).unionByName(d).unionByName(j)


EDGES = """
SELECT n_nationkey::BIGINT * 10 AS eid, 'n' || n_nationkey::VARCHAR AS src, 'r' || n_regionkey::VARCHAR AS dst, 'LOCATED_IN' AS rel FROM nation
UNION ALL SELECT s_suppkey * 10 + 1, 's' || s_suppkey::VARCHAR, 'n' || s_nationkey::VARCHAR, 'OPERATES_IN' FROM supplier
UNION ALL SELECT doc_id * 10 + 2, source, 'c' || doc_id::VARCHAR, 'HAS_CHUNK' FROM documents
UNION ALL SELECT s_suppkey * 10 + 3, 's' || s_suppkey::VARCHAR, 'src' || (s_suppkey % 20)::VARCHAR, 'REPORTED' FROM supplier
"""


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as points of their source, thirty numbers a page, with the vectors that share their number; a page has a table of one summary and nine rows."""
    at = F.col("doc_id") % 30
    kind = F.when(at == 0, "table_summary").when(at < 10, "table_row").otherwise("paragraph")
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("doc_id"), F.floor(F.col("doc_id") / 30).cast("int").alias("page"), kind.alias("type"), "text", "lang")
    return own.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id", "left")


PASSAGES = """SELECT doc_id AS id, source AS doc_id, (doc_id // 30)::INTEGER AS page, CASE WHEN doc_id % 30 = 0 THEN 'table_summary' WHEN doc_id % 30 < 10 THEN 'table_row' ELSE 'paragraph' END AS type, text, lang, embedding::DOUBLE[] AS embedding
FROM documents LEFT JOIN embeddings ON vec_id = doc_id"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as requests that name a page in two ways, a table, a source or nothing; some have a language or further sources as constraints."""
    n, page = F.col("item_id"), F.floor(F.col("item_id") / 3).cast("string")
    said = F.when(n % 6 == 0, F.concat(F.lit(" page "), page)).when(n % 6 == 1, F.lit(" 表格")).when(n % 6 == 2, F.concat(F.lit(" src"), (n % 20).cast("string"))).when(n % 6 == 3, F.concat(F.lit("，第"), page, F.lit("頁"))).otherwise("")
    equal = F.when(n % 5 == 4, F.create_map(F.lit("lang"), F.array(F.lit("en"), F.lit("de"))))
    own = table(spark, sf_dir, "benchmark").select(n.alias("query_id"), F.concat("text", said).alias("query"), (n % 12 + 1).cast("int").alias("top_k"), F.element_at(F.array(F.lit(0.0), F.lit(0.3), F.lit(0.9)), (n % 3 + 1).cast("int")).alias("threshold"), F.when(n % 7 == 3, F.array(F.lit("src3,"), F.lit("nowhere"))).alias("doc_ids"), equal.alias("equal"))
    return own.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id", "left")


REQUESTS = """SELECT item_id AS query_id, text, (item_id % 12 + 1)::INTEGER AS top_k, [0.0, 0.3, 0.9][(item_id % 3 + 1)::INTEGER]::DOUBLE AS threshold, embedding::DOUBLE[] AS vector,
  list_distinct(list_concat(CASE WHEN item_id % 7 = 3 THEN ['src3', 'nowhere'] ELSE [] END, CASE WHEN item_id % 6 = 2 THEN (SELECT list(DISTINCT source) FROM documents WHERE contains('src' || (item_id % 20)::VARCHAR, source)) ELSE [] END)) AS docs,
  CASE WHEN item_id % 6 IN (0, 3) THEN [(item_id // 3)::INTEGER] ELSE [] END AS pages, CASE WHEN item_id % 6 = 1 THEN ['table_row', 'table_summary'] ELSE [] END AS types, CASE WHEN item_id % 5 = 4 THEN ['en', 'de'] ELSE [] END AS langs
FROM benchmark LEFT JOIN embeddings ON vec_id = item_id"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of ingestion tasks; the type of event stands for a status."""
    status = F.element_at(F.array(F.lit("pending"), F.lit("processing"), F.lit("completed"), F.lit("failed")), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("task_id"), F.col("user_id").alias("owner"), status.alias("status"), F.col("ts").cast("timestamp").alias("started_at"), F.col("value"))


TASKS = "SELECT event_id AS task_id, user_id AS owner, ['pending', 'processing', 'completed', 'failed'][(event_id % 4 + 1)::INTEGER] AS status, ts AS started_at, value FROM events"
