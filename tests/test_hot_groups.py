"""Groups that hold most rows, and messages that come in several versions."""

from pyspark.sql import functions as F

from docquarry.operators import rooms, tables


def test_text_of_a_table_with_many_panels(spark):
    panels = spark.range(3000).select(F.lit("d").alias("doc_id"), F.lit("t").alias("table_id"), F.format_string("p%05d", "id").alias("panel"), F.when(F.col("id") < 2, F.concat(F.lit("m"), F.col("id").cast("string"))).alias("metric_leaf"), F.col("id").alias("row_idx"), F.lit(0).alias("col_idx"), F.col("id").cast("string").alias("value_raw"))
    small = panels.limit(2).withColumns({"table_id": F.lit("s"), "panel": F.when(F.col("row_idx") < 0, "x")})
    got = {r.table_id: r.text for r in tables.table_texts(panels.unionByName(small)).collect()}
    assert got["t"] == ", ".join(f"p{i:05d}" for i in range(3000))[:400]
    assert got["s"] == " | m0, m1 | 0, 1"


def test_the_latest_of_several_versions(spark):
    schema = "room_id long, msg_id string, content string, ts timestamp"
    at = lambda *rows: spark.createDataFrame([(r, m, c, None) for r, m, c, _ in rows], schema).withColumn("ts", F.timestamp_seconds(F.element_at(F.create_map(*(F.lit(x) for r in rows for x in (r[2], r[3]))), F.col("content"))))
    messages = at((1, "a", "old", 10))
    known = rooms.created(messages)
    new = at((1, "a", "again", 20), (1, "b", "first", 30), (1, "b", "later", 40), (2, "c", "x", 5), (2, "c", "y", 5))
    for _ in range(2):
        after, kept = rooms.appended(known, messages, new.repartition(4))
        assert sorted((r.msg_id, r.content) for r in kept.collect()) == [("a", "again"), ("b", "later"), ("c", "y")]
        assert sorted((r.room_id, r.message_count) for r in after.collect()) == [(1, 2), (2, 1)]
