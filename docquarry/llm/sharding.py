"""Shards by extendible hashing.

The directory is indexed by the leading bits of a hash of doc_id. A bucket over
the byte limit splits on another bit, and only such buckets do, until each fits.
Sizes are first summed over short prefixes, so a round of eight bits works on
at most 256 cells for each bucket that was still too large.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm import shared

#: Bytes of text in a shard at most.
LIMIT = 1 << 20
#: The same for shards that are written: each is a folder.
WRITE_LIMIT = 1 << 28
HASH_BITS, STEP = 32, 8


def shard(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, depth (bits), shard (their value), shard_bytes, shard_docs and fits for each row.

    Null text has no bytes. A null doc_id is hashed as the empty string. Rows
    that share one doc_id share all bits; where these alone exceed the limit,
    or one document does, the bucket stays at HASH_BITS bits with fits false.
    Other columns are ignored; an empty table gives no rows.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    h = F.conv(F.substring(F.md5(key.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), h.alias("h"))
    waiting, placed = shared.cut_lineage(sized), []
    for bits in range(STEP, HASH_BITS + 1, STEP):
        first = 0 if bits == STEP else bits - STEP + 1
        keyed = waiting.withColumn("cell", F.shiftright("h", HASH_BITS - bits))
        cells = keyed.groupBy("cell").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("d"))
        # sums of the prefixes of a cell: one exchange by the shortest, below which at most 2**STEP cells lie
        short = F.shiftright("cell", bits - max(first - 1, 0))
        choices = []
        for depth in range(first, bits + 1):
            own = Window.partitionBy("short", F.shiftright("cell", bits - depth))
            sums = F.struct(F.lit(depth).alias("depth"), F.shiftright("cell", bits - depth).alias("shard"), F.sum("b").over(own).alias("shard_bytes"), F.sum("d").over(own).alias("shard_docs"))
            choices.append(F.when((F.sum("b").over(own) <= limit) | F.lit(depth == HASH_BITS), sums))
        leaf = cells.withColumn("short", short).select("cell", F.coalesce(*choices).alias("leaf")).where("leaf is not null")
        # up to 16 bits the directory has at most 65,536 rows
        joined = keyed.join(F.broadcast(leaf) if bits <= 16 else leaf, "cell", "left")
        placed.append(joined.where("leaf is not null").select("doc_id", "n_bytes", "leaf.*"))
        waiting = shared.cut_lineage(joined.where("leaf is null").select("doc_id", "n_bytes", "h"))
        if waiting.isEmpty():
            break
    return reduce(DataFrame.unionByName, placed).withColumn("fits", F.col("shard_bytes") <= limit)


def write(docs: DataFrame, path: str, limit: int = WRITE_LIMIT) -> None:
    """The rows of ``docs``, with all their columns, as Parquet, one folder and one file a shard.

    The rows of a shard meet in one task, which its limit allows. The folders
    are named by two columns that ``docs`` does not have: __depth and __shard,
    or these with more underscores. Null and repeated ids are written like any
    others.
    """
    depth, number, own = (shared.new_name(docs, n) for n in ("depth", "shard", "id"))
    places = shard(docs, limit).select(F.col("doc_id").alias(own), F.col("depth").alias(depth), F.col("shard").alias(number)).distinct()
    named = docs.join(places, docs["doc_id"].cast("long").eqNullSafe(F.col(own))).drop(own)
    named.repartition(depth, number).sortWithinPartitions(depth, number).write.partitionBy(depth, number).parquet(path)


ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM documents),
lv AS (SELECT d.*, k::INTEGER AS depth, h >> (32 - k) AS shard FROM d, range(0, 33) r(k)),
s AS (SELECT depth, shard, sum(n_bytes)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_docs FROM lv GROUP BY depth, shard),
m AS (
  SELECT lv.doc_id, lv.n_bytes, lv.depth, lv.shard, shard_bytes, shard_docs,
         row_number() OVER (PARTITION BY lv.doc_id ORDER BY lv.depth) AS pos
  FROM lv JOIN s ON lv.depth = s.depth AND lv.shard = s.shard
  WHERE shard_bytes <= {LIMIT} OR lv.depth = 32)
SELECT doc_id, n_bytes, depth, shard, shard_bytes, shard_docs, shard_bytes <= {LIMIT} AS fits FROM m WHERE pos = 1
"""
