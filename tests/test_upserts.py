"""Upserted tables against a dictionary that takes the same commits."""

import random

import pytest
from pyspark.sql import functions as F

from docquarry.sources.upserts import Folder, UpsertTable

SCHEMA = "k long, v string, n long"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_commits_equal_a_dictionary(spark, tmp_path):
    rnd, held = random.Random(4), {}
    table = UpsertTable(spark, str(tmp_path / "t"), ["k"], "n", buckets=3)
    assert table.read() is None
    for step in range(9):
        batch = [(rnd.choice([None, *range(25)]), f"s{step}-{i}", rnd.randrange(4)) for i in range(rnd.choice([0, 3, 30]))]
        gone = [rnd.randrange(25) for _ in range(3)] if step % 3 == 2 else []
        table.commit(spark.createDataFrame(batch, SCHEMA), spark.createDataFrame([(g,) for g in gone], "k long") if gone else None, "w", step)
        for k in {r[0] for r in batch}:
            held[k] = max((r for r in batch if r[0] == k), key=lambda r: (r[2], r[1]))
        for g in gone:
            if g not in {r[0] for r in batch}:
                held.pop(g, None)
        assert rows(table.read()) == sorted(held.values(), key=repr)
    before = {v: rows(table.read(v)) for v in table.versions()}
    assert len(before) == 9
    table.expire(2)
    assert table.versions() == [7, 8] and rows(table.read(7)) == before[7] and rows(table.read()) == before[8]


def test_a_repeated_batch_and_a_broken_commit_change_nothing(spark, tmp_path, monkeypatch):
    table = UpsertTable(spark, str(tmp_path / "t"), ["k"])
    table.commit(spark.createDataFrame([(1, "a", 1), (2, "b", 1)], SCHEMA), writer="w", batch=0)
    again = spark.createDataFrame([(1, "z", 9)], SCHEMA)
    assert table.commit(again, writer="w", batch=0).version == 0 and table.commit(again, writer="other", batch=0).version == 1
    monkeypatch.setattr(Folder, "put", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        table.commit(spark.createDataFrame([(2, "y", 9)], SCHEMA), writer="w", batch=1)
    monkeypatch.undo()
    assert rows(table.read()) == [(1, "z", 9), (2, "b", 1)]
    table.commit(spark.createDataFrame([(2, "y", 9)], SCHEMA), writer="w", batch=1)
    assert rows(table.read()) == [(1, "z", 9), (2, "y", 9)]


def test_bytes_written_follow_the_batch(spark, tmp_path):
    table = UpsertTable(spark, str(tmp_path / "t"), ["k"], buckets=8)
    whole = spark.range(200_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"), F.lit(0).cast("long").alias("n"))
    first = table.commit(whole).written
    small = [table.commit(whole.where(f"k % 20000 = {i}").withColumn("n", F.lit(1).cast("long"))).written for i in range(6)]
    assert max(small) < first / 50
    assert table.read().agg(F.sum("n")).first()[0] == 60 and table.read().count() == 200_000
    assert max(map(len, table.manifest().sets.values())) <= 6


def test_groups_replace_all_rows_of_a_key(spark, tmp_path):
    table = UpsertTable(spark, str(tmp_path / "t"), ["k"], groups=True)
    table.commit(spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], SCHEMA))
    table.commit(spark.createDataFrame([(1, "d", 1)], SCHEMA))
    assert rows(table.read()) == [(1, "d", 1), (2, "c", 1)]
    table.commit(None, spark.createDataFrame([(2,)], "k long"))
    assert rows(table.read()) == [(1, "d", 1)]
    table.commit(None, spark.createDataFrame([(1,)], "k long"))
    assert rows(table.read()) == [] and not table.manifest().sets


def test_new_columns_and_another_key(spark, tmp_path):
    table = UpsertTable(spark, str(tmp_path / "t"), ["k"])
    table.commit(spark.createDataFrame([(1, "a", 1)], SCHEMA))
    table.commit(spark.createDataFrame([(2, "b", 1, 0.5)], SCHEMA + ", score double"))
    assert rows(table.read()) == [(1, "a", 1, None), (2, "b", 1, 0.5)]
    with pytest.raises(ValueError):
        UpsertTable(spark, str(tmp_path / "t"), ["v"]).commit(spark.createDataFrame([(1, "a", 1)], SCHEMA))


def test_merging_shuffles_once(spark, tmp_path, monkeypatch):
    written, write = [], UpsertTable._write
    monkeypatch.setattr(UpsertTable, "_write", lambda self, rows, folder, own: (written.append((folder, rows._jdf.queryExecution().executedPlan().toString())), write(self, rows, folder, own))[1])
    table = UpsertTable(spark, str(tmp_path / "t"), ["k"], groups=True, buckets=2)
    for text in ("a", "b"):
        table.commit(spark.createDataFrame([(k, text) for k in range(3)], "k long, v string"))
    plans = [p for folder, p in written if folder.startswith("data/c")]
    assert len(plans) == 1 and plans[0].count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, table.read().collect())) == [(k, "b") for k in range(3)]
