"""Retrieval for requests as rows: each with constraints, limits and a threshold of its own, all in one plan.

A request is a row (query_id, query, top_k, threshold, doc_ids, pages, types,
equal), where equal maps names of point columns to the values allowed; an empty
or null set allows everything. Points are rows (id, doc_id, page, type, text,
embedding) with whole numbers as ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import slots, text
from docquarry.operators import evidence, search
from docquarry.operators.vectors import usable

MOST_K = 50
#: Points that are scored against a block of requests at once.
STEP = 2_000
_SETS = {"doc_ids": "array<string>", "pages": "array<int>", "types": "array<string>", "equal": "map<string,array<string>>"}


def completed(requests: DataFrame) -> DataFrame:
    """Requests with all columns: limits clamped, missing ones filled, ids of documents without punctuation at their end; blank questions and null ids are left out."""
    own = requests
    for name, kind in _SETS.items():
        none = F.create_map() if kind.startswith("map") else F.array()
        own = own.withColumn(name, F.coalesce(F.col(name).cast(kind), none.cast(kind)) if name in own.columns else none.cast(kind))
    k = F.coalesce(F.col("top_k"), F.lit(6)) if "top_k" in own.columns else F.lit(6)
    least = F.coalesce(F.col("threshold"), F.lit(0.0)) if "threshold" in own.columns else F.lit(0.0)
    k, least = search.clamped(k.cast("int"), least.cast("double"))
    docs = F.transform("doc_ids", lambda d: F.regexp_replace(d, "[,.!?;:]+$", ""))
    own = own.withColumns({"query_id": F.col("query_id").cast("long"), "top_k": k, "threshold": least, "doc_ids": docs})
    return own.where(F.col("query_id").isNotNull() & (F.trim(F.coalesce("query", F.lit(""))) != ""))


def parsed(requests: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Requests with what their questions say added to their constraints: pages, content types and, of ``known`` (doc_id), documents.

    The question loses what was understood; one that is nothing else stays as it is.
    """
    own = requests.withColumns({
        "pages": F.array_distinct(F.concat("pages", text.page_numbers(F.col("query")).cast("array<int>"), evidence.numeral_pages(F.col("query")))),
        "types": F.array_distinct(F.concat("types", text.content_types(F.col("query")))),
        "tables": F.lower("query").rlike(search.TABLE_HINTS),
    })
    if known is not None:
        named = evidence.named_documents(own.select("query_id", "query"), known).groupBy("query_id").agg(F.array_sort(F.collect_set("doc_id")).alias("named"))
        own = own.join(named, "query_id", "left").withColumn("doc_ids", F.array_distinct(F.concat("doc_ids", F.coalesce("named", F.array().cast("array<string>"))))).drop("named")
    longest = F.array_sort(F.filter("doc_ids", lambda d: d != ""), lambda a, b: F.length(b) - F.length(a))
    bare = text.clean_query(F.aggregate(longest, F.col("query"), lambda q, d: F.replace(q, d, F.lit(" "))))
    return own.withColumn("query", F.when(bare != "", bare).otherwise(F.col("query")))


def rewritten(requests: DataFrame) -> DataFrame:
    """Requests with their questions by the slot ``rewrite``."""
    function = slots.slot("rewrite")

    @F.pandas_udf("string")
    def of(questions: pd.Series) -> pd.Series:
        return pd.Series(list(function(questions.tolist())), dtype=object)

    return requests.withColumn("query", of("query"))


def _allowed(must: Column, point: dict[str, Column]) -> Column:
    """Whether a point, by its columns, meets the sets of a request; columns that the point lacks meet none."""
    fits = (~F.map_contains_key(must, name) | F.coalesce(F.array_contains(F.element_at(must, name), column.cast("string")), F.lit(False)) for name, column in point.items())
    return reduce(Column.__and__, fits, F.lit(True))


def dense(points: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, id, score, strict): by request its ``pool`` best points under all its sets and, not strict, under all but that of documents.

    Requests (query_id, vector, doc_ids, must, pool) are sent to the executors in
    blocks of QUERY_BLOCK, each of which takes one scan of the points, whatever
    the sets: a task scores its points by a matrix product and masks it.
    """
    own = asked.where(usable(F.col("vector")))
    blocks = max(1, -(-own.count() // search.QUERY_BLOCK))
    found = []
    for b in range(blocks):
        rows = own.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).orderBy("query_id").select("query_id", "vector", "doc_ids", "must", "pool").collect()
        found.append(_masked(points, rows))
    return reduce(DataFrame.unionByName, found)


def _masked(points: DataFrame, rows: list) -> DataFrame:
    numbers = np.array([r.query_id for r in rows], np.int64)
    width, most = max((len(r.vector) for r in rows), default=1), max((r.pool for r in rows), default=0)
    q = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        q[i, : len(r.vector)] = r.vector
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
    sets = [dict(r.must) | ({"doc_id": list(r.doc_ids)} if r.doc_ids else {}) for r in rows]
    names = sorted({name for s in sets for name in s})
    if missing := [n for n in names if n not in points.columns]:
        raise ValueError(f"points have no column {missing[0]}")
    bound = np.array([bool(r.doc_ids) for r in rows], bool)
    masks = {}
    for name in names:
        free = np.array([name not in s for s in sets], bool)
        named: dict[str, list[int]] = {}
        for i, s in enumerate(sets):
            for value in s.get(name, ()):
                named.setdefault(value, []).append(i)
        masks[name] = (free, named)
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64()), ("strict", pa.bool_())])

    def fits(column: pa.Array, free: np.ndarray, named: dict[str, list[int]]) -> np.ndarray:
        codes = column.dictionary_encode()
        table = np.repeat(free[:, None], len(codes.dictionary) + 1, axis=1)
        for at, value in enumerate(codes.dictionary.to_pylist()):
            table[named.get(value, []), at] = True
        return table[:, codes.indices.fill_null(len(codes.dictionary)).to_numpy(zero_copy_only=False)]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = {strict: (np.zeros((len(rows), 0), np.int64), np.zeros((len(rows), 0))) for strict in (True, False)}
        for whole in batches:
            for start in range(0, whole.num_rows if len(rows) else 0, STEP):
                batch = whole.slice(start, STEP)
                scores = np.round(q @ search.unit_rows(batch.column(1), width).T, 6) + 0.0
                ids = np.broadcast_to(batch.column(0).to_numpy(zero_copy_only=False), scores.shape)
                mask = np.ones(scores.shape, bool)
                for at, name in enumerate(names):
                    if name != "doc_id":
                        mask &= fits(batch.column(2 + at), *masks[name])
                strict = mask & fits(batch.column(2 + names.index("doc_id")), *masks["doc_id"]) if "doc_id" in names else mask
                for kind, own in ((True, strict), (False, mask & bound[:, None])):
                    held_ids, held = kept[kind]
                    held_ids, held = np.concatenate([held_ids, ids], 1), np.concatenate([held, np.where(own, scores, -np.inf)], 1)
                    order = np.lexsort((held_ids, -held), axis=1)[:, :most]
                    kept[kind] = np.take_along_axis(held_ids, order, 1), np.take_along_axis(held, order, 1)
        for kind, (held_ids, held) in kept.items():
            at = held > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(numbers, at.sum(1))), pa.array(held_ids[at]), pa.array(held[at]), pa.array(np.full(at.sum(), kind))], schema=schema)

    own = points.select("id", "embedding", *(F.col(n).cast("string").alias(n) for n in names)).where(F.col("id").isNotNull() & usable(F.col("embedding")))
    return own.mapInArrow(score, "query_id long, id long, score double, strict boolean")


def _ranked(hits: DataFrame, limit: Column, *order: Column | str) -> DataFrame:
    """``rank`` by query, up to a limit of its own."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= limit)


def retrieve(points: DataFrame, requests: DataFrame, cut: Callable[[DataFrame], DataFrame], known: DataFrame | None = None, postings: Callable[[DataFrame], DataFrame] | None = None, engine: str = "hybrid", parse: bool = True) -> DataFrame:
    """(query_id, id, doc_id, page, type, text, score, final_rank) of requests; engine is vector, keyword or hybrid.

    With ``parse`` questions are parsed for constraints, documents only with
    ``known``. Dense
    hits and texts with all tokens come under all sets; a request of documents
    without dense hits gets those of all documents, and failing these the first
    points of its documents. BM25 runs over the pool; the lists are fused by
    rank, the first hit of each place stays, below the threshold only the best,
    asked types come first, tables that are hit bring their summaries and rows,
    and the cross-encoder orders the rest. A column ``vector`` stands for the
    question's own. ``postings`` gives (id, token, tf, dl) for terms, out of a
    stored index perhaps. ``cut`` cuts lineage. The number of steps does not
    depend on how many sets of constraints there are.
    """
    own = completed(requests)
    own = rewritten(parsed(own, known) if parse else own.withColumn("tables", F.lower("query").rlike(search.TABLE_HINTS)))
    if "vector" not in own.columns:
        own = slots.embedded(own, "query", "vector")
    listed = F.map_filter(F.map_concat(F.create_map(F.lit("page"), F.col("pages").cast("array<string>"), F.lit("type"), F.col("types")), "equal"), lambda _, v: F.size(v) > 0)
    typed = F.size("types") > 0
    pool = F.when(typed, F.greatest(F.lit(24), F.least(F.lit(120), 8 * F.col("top_k")))).otherwise(F.greatest(F.lit(18), F.least(F.lit(80), 6 * F.col("top_k"))))
    asked = cut(own.select("query_id", "query", "top_k", "threshold", "doc_ids", "types", "vector", listed.alias("must"), pool.cast("int").alias("pool"), (typed | F.col("tables")).alias("tables")))
    limits = asked.select("query_id", "top_k", "threshold", "pool", "types", (F.size("doc_ids") > 0).alias("bound"))
    payload = points.select("id", "doc_id", "page", "type")
    none = limits.select("query_id", F.lit(None).cast("long").alias("id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    near = cut(_dense_ladder(points, asked, limits)) if engine != "keyword" else none
    terms = cut(search.query_terms(asked))
    exact = cut(_with_all_words(points, asked, terms, postings)) if engine != "vector" else none
    lists = [near, exact]
    if engine != "vector":
        candidates = near.select("query_id", "id").unionByName(exact.select("query_id", "id")).distinct()
        scores = search.pool_bm25(candidates.join(points.select("id", "text"), "id"), terms)
        lists.append(_ranked(scores.join(limits.select("query_id", "pool"), "query_id"), F.col("pool"), F.desc("score"), "id"))
    fused = search.fuse(lists if engine != "vector" else [near], 5 * MOST_K).join(limits.select("query_id", "top_k"), "query_id").where(F.col("rank") <= 5 * F.col("top_k"))
    scored = search.best_per_id([near, exact]).select("query_id", "id", "score").join(fused.select("query_id", "id", "rrf"), ["query_id", "id"]).join(payload, "id").join(limits, "query_id")
    places = search.confidence_gate(search.first_per_place(scored), F.col("threshold"))
    preferred = F.when(F.array_contains("types", F.col("type")), 0).otherwise(1)
    ranked = cut(_ranked(places, 5 * F.col("top_k"), preferred, F.desc("rrf"), "id").select("query_id", "id", "doc_id", "page", "type", F.col("rrf").alias("score"), "rank"))
    wide = ranked.join(asked.where("tables").select("query_id", "top_k"), "query_id")
    tables = search.table_evidence(wide, payload.withColumn("top_k", F.lit(None).cast("int")), F.col("top_k")).select(ranked.columns)
    named = ranked.unionByName(tables).join(asked.select("query_id", "query", "top_k"), "query_id").join(points.select("id", "text"), "id")
    best = search.reranked(named, MOST_K).where(F.col("final_rank") <= F.col("top_k"))
    return best.select("query_id", "id", "doc_id", "page", "type", "text", F.col("rerank").alias("score"), "final_rank")


def _dense_ladder(points: DataFrame, asked: DataFrame, limits: DataFrame) -> DataFrame:
    """(query_id, id, score, rank): under all sets; for requests of documents without any, of all documents; else the documents' first points."""
    least = F.when(F.col("strict") & F.col("bound"), F.least(F.col("threshold"), F.lit(search.RELAXED))).otherwise(F.col("threshold"))
    hits = dense(points, asked).join(limits, "query_id").where(F.col("score") >= least)
    rung = F.max("strict").over(Window.partitionBy("query_id"))
    near = _ranked(hits.withColumn("rung", rung).where(F.col("strict") == F.col("rung")), F.col("pool"), F.desc("score"), "id").select("query_id", "id", "score", "rank")
    # a document's first points are found once, whatever the number of requests for it
    wanted = asked.select("query_id", "top_k", F.explode(F.array_distinct("doc_ids")).alias("doc_id"))
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("id"))
    first = points.where("id is not null").select("id", "doc_id").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("at", at).where(F.col("at") <= MOST_K)
    last = _ranked(wanted.join(first, "doc_id"), F.greatest(F.col("top_k"), F.lit(3)), "id").select("query_id", "id", F.lit(0.0).alias("score"), "rank")
    return search.with_relaxation(near, last)


def _with_all_words(points: DataFrame, asked: DataFrame, terms: DataFrame, postings: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """(query_id, id, score, rank): points under all sets whose text has every token of the question, by id, three times top_k of them."""
    index = postings(terms) if postings else search.postings(points.select("id", "text"), terms)
    need = terms.groupBy("query_id").agg(F.count("*").alias("need"))
    hits = terms.join(index, "token").groupBy("query_id", "id").agg(F.count("*").alias("have")).join(need, "query_id").where("have = need").select("query_id", "id")
    sets = asked.select("query_id", "top_k", "doc_ids", "must")
    others = [c for c in points.columns if c not in ("id", "text", "embedding")]
    fit = _allowed(F.col("must"), {c: F.col(f"p.{c}") for c in others}) & ((F.size("doc_ids") == 0) | F.array_contains("doc_ids", F.col("p.doc_id").cast("string")))
    own = hits.join(points.select("id", F.struct(*others).alias("p")), "id").join(sets, "query_id").where(fit)
    return _ranked(own.select("query_id", "id", "top_k"), 3 * F.col("top_k"), "id").select("query_id", "id", F.lit(0.0).alias("score"), "rank")
