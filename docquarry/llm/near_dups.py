"""Near-duplicate documents: fast similarity sketching, banding, exact verification, components.

Sketch: in round i every shingle throws its hash into one bin; a bin keeps the
smallest value of the first round that reaches it. After ``SKETCH`` rounds the
bins still empty get a round of their own, so that every coordinate fills. Two
coordinates agree with the Jaccard similarity of the sets, with concentration.

Documents with one set are one node. Nodes that share a band of sketch
coordinates meet in a bucket. A bucket never emits all its pairs: its most
central node, the one with most company over all bands, is compared with the
others on full sets, then links are merged into components. In buckets that
still hold several components, the nodes outside the largest one are held, in
blocks of bounded size, against all nodes of such buckets. So a link between two
nodes that share a bucket is never lost, and a group of copies of one text takes
one comparison a copy.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm import shared

#: Links need PERCENT * union <= 100 * intersection. With 30 bands of 5 coordinates a pair at 0.8 meets with probability 1 - 7e-6.
PERCENT, BANDS, ROWS = 80, 30, 5
SKETCH = BANDS * ROWS
#: Ids of candidates that are sent to all executors; more of them are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Shingles of the sets that others are held against at once.
BLOCK_SHINGLES = 1_000_000
#: Full sets that are handed to a Python worker at once, and pairs of one pivot that go to one task, about.
PAIRS_AT_ONCE, SALT_PAIRS = 256, 250
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words_each: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a shorter text is one shingle, one without words none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, h.size - words_each + 1)
    out = np.full(n, np.uint64(min(h.size, words_each)))
    for k in range(min(words_each, h.size)):
        out = mix(out * _MIX[2] + h[k : k + n])
    return np.unique(out)


def sketch(shingles: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """``size`` coordinates of a set that is not empty: the round in the high half, the least hash in the low half."""
    out = np.full(size, _NONE)
    block = max(1, -(-10 * size // shingles.size))
    for first in range(0, size, block):
        rounds = np.arange(first, min(size, first + block), dtype=np.uint64)[:, None]
        g = mix(shingles[None, :] ^ mix(rounds + _MIX[2]))
        np.minimum.at(out, (((g >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).ravel(), ((rounds << np.uint64(32)) | (g & np.uint64(0xFFFFFFFF))).ravel())
        if not (out == _NONE).any():
            return out
    for b in np.flatnonzero(out == _NONE):
        i = np.uint64(size + b)
        out[b] = (i << np.uint64(32)) | (mix(shingles ^ mix(np.array([i]) + _MIX[2])) & np.uint64(0xFFFFFFFF)).min()
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """One 64-bit key a band; keys of different bands differ."""
    table = coordinates.reshape(BANDS, ROWS)
    key = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for k in range(ROWS):
        key = mix(key * _MIX[2] + table[:, k])
    return key.view(np.int64)


def signatures(docs: DataFrame, words_each: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit print of the set (null if empty) and its band keys."""
    arrow = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("print", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def sign(doc_ids: list, texts: list) -> dict:
        sets = [shingle_set(t, words_each) for t in texts]
        prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if s.size else None for s in sets]
        known: dict = {}
        bands = []
        for p, s in zip(prints, sets):
            if p is not None and p not in known:
                known[p] = band_keys(sketch(s))
            bands.append(known[p] if p is not None else np.zeros(0, np.int64))
        return {"doc_id": doc_ids, "n_shingles": [s.size for s in sets], "print": prints, "bands": bands}

    return shared.map_texts(docs, sign, "doc_id long, n_shingles long, print binary, bands array<long>", arrow)


def _sets(docs: DataFrame, wanted: DataFrame, words_each: int) -> DataFrame:
    """(doc_id, shingles) with the full sets of the wanted doc_ids."""
    wanted = shared.cut_lineage(wanted.distinct())
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(wanted, "doc_id", "left_semi")
    arrow = pa.schema([("doc_id", pa.int64()), ("shingles", pa.binary())])
    return shared.map_texts(texts, lambda ids, texts: {"doc_id": ids, "shingles": [shingle_set(t, words_each).tobytes() for t in texts]}, "doc_id long, shingles binary", arrow)


def verified(docs: DataFrame, pairs: DataFrame, words_each: int) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) of a pivot ``a`` and a member ``b`` whose full sets are similar enough.

    A pivot's members are dealt over salts of about SALT_PAIRS pairs, and its set goes to each salt once; a member's set goes to each of its pairs.
    """
    pairs = shared.cut_lineage(pairs)
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_PAIRS).cast("int").alias("salts"))
    salts = shared.cut_lineage(salts)
    dealt = pairs.join(salts, "a").select(F.col("b").alias("doc_id"), F.col("a").alias("pivot"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("member"))
    lone = salts.select(F.col("a").alias("doc_id"), F.col("a").alias("pivot"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("member"))
    roles = dealt.unionByName(lone)
    sets = _sets(docs, roles.select("doc_id"), words_each)
    here = roles.join(sets, "doc_id").repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "member")

    def compare(batches):
        group, pivots = None, []
        for batch in batches:
            a, b = [], []
            for doc_id, pivot, salt, member, shingles in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4)):
                x = np.frombuffer(shingles.as_py() if not member else shingles.as_buffer(), np.uint64)
                if (pivot, salt) != group:
                    group, pivots = (pivot, salt), []
                if not member:
                    pivots.append(x)
                    continue
                for y in pivots:
                    common = np.intersect1d(x, y, assume_unique=True).size
                    if common and 100 * common >= PERCENT * (x.size + y.size - common):
                        a.append(pivot)
                        b.append(doc_id)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        shared.give_back()

    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = conf.get(key)
    conf.set(key, str(PAIRS_AT_ONCE))
    try:
        return shared.cut_lineage(here.select("doc_id", "pivot", "salt", "member", "shingles").mapInArrow(compare, "a long, b long").distinct())
    finally:
        conf.set(key, usual)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) with the smallest node reachable over (a, b), for each node on an edge, by alternating large and small stars."""
    now = shared.cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        seen = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written first, so that the join with a hub's edges has exchanges of its own, whose large partitions can be split
        least = shared.cut_lineage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        now = shared.cut_lineage(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a > b").distinct())


def _pairs(pivots: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of a bucket's pivot with its other members that sizes allow to be similar."""
    p = pivots.select("key", F.col("node").alias("p"), F.col("n").alias("pn"))
    joined = members.join(p, "key").where(F.col("node") != F.col("p")).where(100 * F.least("n", "pn") >= PERCENT * F.greatest("n", "pn"))
    return joined.select(F.col("p").alias("a"), F.col("node").alias("b")).distinct()


def _unresolved(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label, odd) of nodes in buckets that hold several labels; odd ones are outside the largest component of one of their buckets."""
    named = members.select("key", "node").join(labels.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    sizes = named.groupBy("key", "label").agg(F.count("*").alias("c"))
    mixed = shared.cut_lineage(sizes.groupBy("key").agg(F.max(F.struct("c", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1").select("key", F.col("top.label").alias("main")))
    return shared.cut_lineage(named.join(mixed, "key").groupBy("node", "label").agg(F.max((F.col("label") != F.col("main")).cast("int")).alias("odd")))


def _late_links(docs: DataFrame, active: DataFrame, words_each: int) -> DataFrame:
    """Links (a, b) between components, of odd nodes with all nodes of ``active``.

    Two nodes of a bucket in different components are not both in its largest
    one, so every link that is still missing has an odd end. The full sets of
    odd nodes are taken in blocks of bounded size, each as an index from a
    shingle to its nodes, and every other set is held against a block at once;
    only links come out, one for each node and component it is linked with.
    """
    if active.isEmpty():
        return docs.sparkSession.createDataFrame([], "a long, b long")
    sets = shared.cut_lineage(_sets(docs, active.select(F.col("node").alias("doc_id")), words_each).join(active.withColumnRenamed("node", "doc_id"), "doc_id"))
    odd = sets.where("odd = 1")
    blocks = max(1, -(-(odd.agg(F.sum(F.length("shingles"))).first()[0] or 0) // (8 * BLOCK_SHINGLES)))
    found = None
    for b in range(blocks):
        rows = odd.where(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == b).select("doc_id", "label", "shingles").collect()  # about BLOCK_SHINGLES numbers
        links = shared.cut_lineage(sets.select("doc_id", "label", "shingles").mapInArrow(_against(rows), "a long, b long"))
        found = links if found is None else found.unionByName(links)
    return found


def _against(rows: list):
    """A function that holds sets against those of ``rows`` (doc_id, label, shingles)."""
    ids, labels = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
    own = [np.frombuffer(r[2], np.uint64) for r in rows]
    sizes = np.array([o.size for o in own], np.int64)
    flat = np.concatenate(own) if own else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], np.repeat(np.arange(len(own)), sizes)[order]

    def compare(batches):
        for batch in batches:
            a: list[int] = []
            b: list[int] = []
            for node, label, shingles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                x = np.frombuffer(shingles.as_buffer(), np.uint64)
                first, last = np.searchsorted(flat, x, "left"), np.searchsorted(flat, x, "right")
                n = last - first
                at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                common = np.bincount(owner[at], minlength=ids.size)
                near = np.flatnonzero((100 * common >= PERCENT * (x.size + sizes - common)) & (labels != label))
                if near.size:
                    _, one = np.unique(labels[near], return_index=True)
                    a += [node] * one.size
                    b += ids[near[one]].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return compare


def near_duplicates(docs: DataFrame, words_each: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs``.

    Words are those between ASCII white space, A-Z lower-cased. Texts without
    words (null, empty, blank) have no set and are linked with nothing. Rows
    with one doc_id are one document. Rows with a null doc_id cannot be named
    in a link: they keep a null component_id and are kept. Other columns are
    ignored. Of equal documents the one with the smallest doc_id is kept.
    Whole texts count, however long, each in one task; an empty table gives no rows.
    """
    signed = shared.cut_lineage(signatures(docs, words_each))
    real = signed.where("doc_id is not null and print is not null")
    nodes = shared.cut_lineage(real.groupBy("print").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    named = real.select("doc_id", "print").distinct().join(nodes.select("print", "node"), "print")
    versions = named.groupBy("doc_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("doc_id", "lo")
    same_id = named.join(versions, "doc_id").select(F.col("node").alias("a"), F.col("lo").alias("b"))

    banded = nodes.select("node", "n", F.explode("bands").alias("key"))
    shared_keys = shared.cut_lineage(banded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"))  # written first: see components()
    members = shared.cut_lineage(banded.join(shared_keys, "key"))
    company = members.groupBy("node").agg(F.sum("c").alias("company"))
    ranked = members.join(company, "node")
    pivots = ranked.groupBy("key").agg(F.max(F.struct("company", -F.col("node"), "n")).alias("top")).select("key", (-F.col("top.col2")).alias("node"), F.col("top.n").alias("n"))
    pivots = shared.cut_lineage(pivots)
    links = verified(docs, _pairs(pivots, members), words_each)
    labels = components(links.unionByName(same_id))
    rest = members.join(pivots.select("key", "node"), ["key", "node"], "left_anti")
    labels = components(_late_links(docs, _unresolved(rest, labels), words_each).unionByName(labels.toDF("a", "b")))
    of_print = nodes.select("print", "node").join(labels, "node", "left").select("print", F.coalesce("label", "node").alias("label"))
    out = signed.select("doc_id", "n_shingles", "print").join(of_print, "print", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))
