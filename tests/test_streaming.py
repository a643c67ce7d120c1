import os

import pytest
from pyspark.sql import functions as F

from docquarry.streaming import events

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("name,key", [("tumbling", ["start", "event_type"]), ("sliding", ["start", "event_type"])])
def test_a_stream_gives_what_a_batch_gives(spark, tmp_path, name, key):
    source = spark.read.parquet(f"{SF}/events.parquet")
    stream = spark.readStream.schema(source.schema).parquet(f"{SF}/events.parque[t]")
    window = getattr(events, name)
    events.run_once(window(stream), events.upsert_batches(str(tmp_path / "t"), key), str(tmp_path / "c"), "update")
    assert rows(events.version(spark, str(tmp_path / "t"))) == rows(window(source))


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    batch = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sink = events.upsert_batches(str(tmp_path / "t"), ["k"])
    sink(batch, 0)
    sink(batch.withColumn("v", F.upper("v")).where("k = 2"), 1)
    want = [(1, "a"), (2, "B")]
    assert rows(events.version(spark, str(tmp_path / "t"))) == want
    sink(batch.withColumn("v", F.upper("v")).where("k = 2"), 1)
    assert rows(events.version(spark, str(tmp_path / "t"))) == want


def test_ring_buffer_and_single_delivery(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "room_id long, msg_id string, seq long, ts timestamp"
    held = {}

    def keep(batch, _):
        for r in batch.collect():
            held.setdefault(r.room_id, {})[r.place] = r.msg_id

    for part in range(2):
        data = [(i % 2, f"m{part}-{i}", part * 100 + i, None) for i in range(10)]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        events.run_once(events.ring_buffer(stream, 3), keep, str(tmp_path / "c"), "update")
    assert held == {0: {1: "m1-4", 2: "m1-6", 3: "m1-8"}, 1: {1: "m1-5", 2: "m1-7", 3: "m1-9"}}
    twice = spark.createDataFrame([(1, "a", 1, None), (1, "a", 1, None)], schema)
    assert events.delivered_once(twice, "msg_id").count() == 1
