import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from docquarry.llm import sharding


def brute_force(rows, limit):
    """Split a bucket on another bit as long as it is too large."""
    h = [int(hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()[:8], 16) for d, _ in rows]
    n = [len((t or "").encode()) for _, t in rows]
    out = {}

    def place(members, depth):
        size = sum(n[i] for i in members)
        if size <= limit or depth == 32:
            for i in members:
                out[i] = (depth, h[i] >> (32 - depth), size, len(members), size <= limit)
            return
        halves = defaultdict(list)
        for i in members:
            halves[h[i] >> (31 - depth) & 1].append(i)
        for half in halves.values():
            place(half, depth + 1)

    place(list(range(len(rows))), 0)
    return sorted(((-1 if d is None else d), n[i], *out[i]) for i, (d, _) in enumerate(rows))


def run(df, limit):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.depth, r.shard, r.shard_bytes, r.shard_docs, r.fits) for r in sharding.shard(df, limit).collect())


def test_equals_splitting_one_by_one(spark):
    rows = [(i, "é" * (i % 40)) for i in range(700)] + [(7, "again" * 9), (7, "again" * 9), (None, None), (None, "null id"), (900, None), (901, ""), (902, "z" * 5000)]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, shard string")
    for limit in (10, 200, 3000, 10**6):
        assert run(df, limit) == brute_force(rows, limit)
    assert sharding.shard(df.limit(0), 10).count() == 0


def test_folders_hold_every_row_once(spark, tmp_path):
    rows = [(i, "text " * (i % 9), "en", i) for i in range(100)] + [(None, "no id", "x", 1), (7, "text " * 7, "en", 7), (200, "z" * 100_000, "y", 0), (201, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, depth string, __shard long")
    sharding.write(df, str(tmp_path / "out"), 300)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r.doc_id, r.text, r.depth, r["__shard"]) for r in back.collect()) == Counter(rows)
    sizes = back.groupBy("__depth", "___shard").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("b"), F.count("*").alias("n")).collect()
    assert all(r.b <= 300 or r.n == 1 for r in sizes)
    assert sum(1 for _ in (tmp_path / "out").rglob("*.parquet")) == len(sizes)
