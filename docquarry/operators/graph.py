"""Property-graph operators on two frames: vertices (id, label, props) and edges (eid, src, dst, rel)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import numeric, text

#: Relations that a traversal may take, and those that are structure only.
ALLOWED_RELATIONS = (
    "SUBSIDIARY_OF", "BUSINESS_UNIT_OF", "BRAND_OF", "AUDITED_BY", "HOLDS_ROLE", "ROLE_AT", "MEMBER_OF", "LISTED_AS",
    "OPERATES_IN", "LOCATED_IN", "HAS_FACILITY", "PRODUCES", "IN_CATEGORY", "HELD_EVENT", "TOOK_PLACE_ON", "REPORTED",
    "HAS_ACCOUNT_ITEM", "FOR_PERIOD", "HAS_VALUE", "DENOMINATED_IN", "HAS_PERCENTAGE", "COMPLIES_WITH", "SUBJECT_TO",
    "PARTNERS_WITH", "HAS_CHUNK", "HAS_DOCUMENT", "HAS_ENTITY", "IN_TABLE", "HAS_OBSERVATION",
)
FALLBACK_RELATIONS = ("HAS_CHUNK", "HAS_DOCUMENT", "RELATED_TO")
STRUCTURAL = ("HAS_CHUNK", "HAS_DOCUMENT", "HAS_ENTITY")


def relation_types(edges: DataFrame) -> DataFrame:
    return edges.select("rel").distinct()


def allowed_types(edges: DataFrame, allowed: Sequence[str] = ALLOWED_RELATIONS) -> DataFrame:
    """Allowed relations that occur; without any, all that occur."""
    found = relation_types(edges)
    some = found.where(F.col("rel").isin(*allowed))
    return some.unionByName(found.where(some.agg(F.count("*") == 0).scalar()))


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("eid", F.col("src").alias("a"), F.col("dst").alias("b"), "rel").unionByName(edges.select("eid", F.col("dst").alias("a"), F.col("src").alias("b"), "rel"))


def relation_frequency(edges: DataFrame, seeds: DataFrame, most: int = 10) -> DataFrame:
    """Relations at the seeds (id) in either direction with their counts, the most frequent ``most``."""
    near = undirected(edges).join(seeds, F.col("a") == F.col("id"), "left_semi")
    counted = near.groupBy("rel").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "rel").limit(most)


def entity_counts(edges: DataFrame) -> DataFrame:
    """Targets and relations by source, without structure."""
    return edges.where(~F.col("rel").isin(*STRUCTURAL)).groupBy("src").agg(F.countDistinct("dst").alias("entities"), F.count("*").alias("relations"))


def expand(edges: DataFrame, seeds: DataFrame, hops: int, top_k: int, chunk_prefix: str = "c", relations: Sequence[str] | None = None) -> DataFrame:
    """(seed, chunk, bonus, rank): weighted paths of 1 to ``hops`` edges from the seeds (id), no edge twice.

    A path's bonus is the sum of its relations' weights. One that ends outside
    chunks credits its seed. The best bonus of each chunk counts. Edges are
    pruned to the asked relations first; paths that come to one node over the
    same edges in another order are one, so the frontier holds no repeats.
    """
    own = edges if relations is None else edges.where(F.col("rel").isin(*relations))
    step = undirected(own).withColumn("w", numeric.relation_weight(F.col("rel")))
    front = seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.array().cast("array<long>").alias("used"), F.lit(0.0).alias("bonus"))
    reached = None
    for hop in range(hops):
        walked = front.join(step, F.col("node") == F.col("a")).where(~F.array_contains("used", F.col("eid")))
        front = walked.select("seed", F.col("b").alias("node"), F.array_sort(F.array_append("used", F.col("eid"))).alias("used"), F.round(F.col("bonus") + F.col("w"), 6).alias("bonus"))
        if hop:
            front = front.dropDuplicates(["seed", "node", "used"])
        found = front.groupBy("seed", "node").agg(F.max("bonus").alias("bonus"))
        reached = found if reached is None else reached.unionByName(found)
    chunk = F.when(F.col("node").rlike(f"^{chunk_prefix}[0-9]+$"), F.col("node")).otherwise(F.col("seed"))
    best = reached.select("seed", chunk.alias("chunk"), "bonus").groupBy("seed", "chunk").agg(F.max("bonus").alias("bonus"))
    rank = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("bonus"), "chunk"))
    return best.withColumn("rank", rank).where(F.col("rank") <= top_k)


def relaxed_relations(edges: DataFrame, seeds: DataFrame, allowed: Sequence[str], most: int = 10) -> DataFrame:
    """Allowed relations at the seeds; without any there, the most frequent first edges of paths of up to two."""
    at_seeds = undirected(edges).join(seeds, F.col("a") == F.col("id"), "left_semi")
    some = at_seeds.where(F.col("rel").isin(*allowed)).select("rel").distinct()
    second = undirected(edges).select(F.col("eid").alias("eid2"), F.col("a").alias("b2"))
    paths = at_seeds.select("eid", "rel", "b").join(second, (F.col("b") == F.col("b2")) & (F.col("eid") != F.col("eid2"))).select("rel")
    counted = at_seeds.select("rel").unionByName(paths).groupBy("rel").count().orderBy(F.desc("count"), "rel").limit(most).select("rel")
    return some.unionByName(counted.where(some.agg(F.count("*") == 0).scalar()))


def with_temporary_seeds(edges: DataFrame, hits: DataFrame, chunks: DataFrame, most: int = 3) -> DataFrame:
    """The edges and, for hits (id, doc_id, rank) that the graph does not know, edges to their document and its chunks (id, doc_id).

    At most ``most`` hits of each query frame are taken, in rank order. Their
    edges have negative eids and are never stored.
    """
    known = undirected(edges).select(F.col("a").alias("id")).distinct()
    new = hits.join(known, "id", "left_anti").orderBy("rank", "id").limit(most)
    to_doc = new.select(F.concat(F.lit("temp_"), F.col("id")).alias("src"), F.col("doc_id").alias("dst"), F.lit("HAS_CHUNK").alias("rel"))
    to_chunks = new.join(chunks.select(F.col("id").alias("dst"), "doc_id"), "doc_id").select(F.concat(F.lit("temp_"), F.col("id")).alias("src"), "dst", F.lit("RELATED_TO").alias("rel"))
    both = to_doc.unionByName(to_chunks)
    return edges.unionByName(both.select((-F.abs(F.xxhash64("src", "dst", "rel"))).alias("eid"), "src", "dst", "rel"))


def communities(edges: DataFrame, checkpoint) -> DataFrame:
    """(id, community) with the smallest id reachable, by alternating large and small stars.

    Least neighbours are summed up before a shuffle and written before they are
    joined with a hub's edges, whose partitions can be split then.
    """
    now = checkpoint(edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            linked = now.select(F.col("a").alias("id"), F.col("b").alias("community")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("community")).distinct())
            alone = edges.where("src = dst").select(F.col("src").alias("id"), F.col("src").alias("community")).distinct()
            return linked.unionByName(alone.join(linked.select("id"), "id", "left_anti"))
        mark = seen
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = checkpoint(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = checkpoint(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        down = checkpoint(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(down, "a")
        now = checkpoint(small.select("a", F.col("m").alias("b")).unionByName(small.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())


def evidence(edges: DataFrame, hits: DataFrame, k: int, checkpoint) -> DataFrame:
    """(query_id, id, score, rank): the k chunks of each query with the best bonus, two edges from its hits (query_id, id), hits themselves left out as seeds of their own.

    Chunks are vertices ``c`` and a number. The two edges meet in a document;
    its chunks are counted once for a query, whatever hits lead there. As a
    query leaves out one chunk of a document at most, the first k + 1 of each
    document hold its first k, and no others meet the queries.
    """
    near = edges.where("rel = 'HAS_CHUNK'").select(F.col("src").alias("doc"), F.col("dst").alias("node"))
    weight = F.round(2 * numeric.relation_weight(F.lit("HAS_CHUNK")), 6)
    seeds = hits.select("query_id", F.concat(F.lit("c"), F.col("id").cast("string")).alias("node")).distinct()
    docs = checkpoint(seeds.join(near, "node").groupBy("query_id", "doc").agg(F.count("*").alias("seeds"), F.min("node").alias("seed")))
    first = near.withColumn("at", F.dense_rank().over(Window.partitionBy("doc").orderBy("node"))).where(F.col("at") <= k + 1).drop("at")
    found = docs.join(first, "doc").where((F.col("seeds") > 1) | (F.col("node") != F.col("seed"))).select("query_id", "node").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("node"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", F.substring("node", 2, 20).cast("long").alias("id"), weight.alias("score"), "rank")


def star(nodes: DataFrame) -> DataFrame:
    """Edges from documents to their chunks (doc_id, id)."""
    return nodes.select(F.col("doc_id").alias("src"), F.col("id").alias("dst"), F.lit("HAS_CHUNK").alias("rel")).distinct()


def cube_vertices(observations: DataFrame) -> DataFrame:
    """Distinct vertices (id, label) of observations: data sets, tables, metrics, observations, dimension types and values."""
    def of(label: str, key) -> DataFrame:
        return observations.select(key.alias("id"), F.lit(label).alias("label"))

    dims = observations.select(F.explode("dimensions").alias("k", "v"))
    parts = [of("Dataset", F.col("doc_id")), of("Table", F.concat_ws("#", "doc_id", "table_id")), of("Metric", F.col("metric_leaf")), of("Observation", F.col("source_hash"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    types = dims.select(F.col("k").alias("id"), F.lit("DimType").alias("label"))
    values = dims.select(F.concat_ws("=", "k", "v").alias("id"), F.lit("DimVal").alias("label"))
    return out.unionByName(types).unionByName(values).distinct()


def cube_edges(observations: DataFrame) -> DataFrame:
    """Distinct edges (src, dst, rel) between the vertices of ``cube_vertices``."""
    tables = observations.select(F.concat_ws("#", "doc_id", "table_id").alias("src"), F.col("doc_id").alias("dst"), F.lit("IN_DATASET").alias("rel"))
    placed = observations.select(F.col("source_hash").alias("src"), F.concat_ws("#", "doc_id", "table_id").alias("dst"), F.lit("IN_TABLE").alias("rel"))
    metric = observations.select(F.col("source_hash").alias("src"), F.col("metric_leaf").alias("dst"), F.lit("OF_METRIC").alias("rel"))
    dims = observations.select("source_hash", F.explode("dimensions").alias("k", "v"))
    value = dims.select(F.col("source_hash").alias("src"), F.concat_ws("=", "k", "v").alias("dst"), F.lit("FOR_DIM").alias("rel"))
    kind = dims.select(F.concat_ws("=", "k", "v").alias("src"), F.col("k").alias("dst"), F.lit("OF_TYPE").alias("rel"))
    return tables.unionByName(placed).unionByName(metric).unionByName(value).unionByName(kind).distinct()


def sanitized(triples: DataFrame, *others: str) -> DataFrame:
    """Triples (src, rel, dst) with both ends, names of at most 256 characters and safe labels; ``others`` are columns that stay."""
    has = triples.where((F.trim(F.coalesce("src", F.lit(""))) != "") & (F.trim(F.coalesce("dst", F.lit(""))) != ""))
    return has.select(F.substring(F.trim("src"), 1, 256).alias("src"), text.graph_label(F.col("rel"), "RELATED_TO").alias("rel"), F.substring(F.trim("dst"), 1, 256).alias("dst"), *others)


def stamped(nodes: DataFrame, doc_id: str, corpus: str) -> DataFrame:
    """doc_id and corpus_id where they are missing."""
    return nodes.withColumns({"doc_id": F.coalesce("doc_id", F.lit(doc_id)), "corpus_id": F.coalesce("corpus_id", F.lit(corpus))})


def linked_rows(chunks: DataFrame, observations: DataFrame) -> DataFrame:
    """HAS_OBSERVATION edges from row chunks to observations of the same document, table and row."""
    keys = ["doc_id", "table_id", "row_idx"]
    return chunks.select(*keys, F.col("id").alias("src")).join(observations.select(*keys, F.col("source_hash").alias("dst")), keys).select("src", "dst", F.lit("HAS_OBSERVATION").alias("rel"))


