"""Hard negatives by a vector-approximation file.

Anchors in blocks meet all rows in groups of bounded size. A group's
approximation gives each component one of 64 cells; tables of an anchor's
product with each cell's two ends, looked up and summed, bound a row's score
from below and above. Only rows whose bounds reach into a window that still
has a place are scored exactly. The best few of each group are ranked again
over all groups. A first pass finds each anchor's positives, a second one the
negatives in the windows that these open.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm import shared

#: Every so many ids one is an anchor; positives of an anchor; negatives of each positive.
EVERY, POSITIVES, NEGATIVES = 100, 5, 5
#: A negative's score is at least this share of the positive's, in hundredths.
SHARE = 80
#: Cells of a component.
CELLS = 64
#: Anchors of a block; rows of a group, the more of them the more rows there are.
ANCHORS, GROUP_LEAST, GROUP_MOST = 2_048, 2_048, 65_536
#: Rows and anchors whose bounds are held at once.
ROWS_EACH, ANCHORS_EACH = 1_024, 128
#: Components beyond this have inner products that a long may not hold.
LARGEST = 1 << 26
_LEAST = np.iinfo(np.int64).min


def prepared(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, vec (whole numbers) of the rows that take part, one a vec_id.

    Rows with a null id, label, vector or component, or with one that is not
    finite or exceeds LARGEST, take no part. Of rows that share an id the least
    by label and vector counts.
    """
    vector = F.col("embedding").cast("array<double>")
    usable = F.forall(vector, lambda x: F.coalesce((F.abs(x * 256.0) < float(LARGEST)), F.lit(False)))
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = embeddings.where("vec_id is not null and label is not null and embedding is not null").where(usable)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(label.alias("label"), F.transform(vector, lambda x: F.floor(x * 256.0).cast("int")).alias("vec")).alias("row"))
    return rows.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.*")


def _matrix(column: pa.ChunkedArray, wide: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), wide), np.int64)
    out[np.arange(wide) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


class Approximation:
    """Cells of a group's components."""

    def __init__(self, vectors: np.ndarray):
        self.least = vectors.min(0, initial=0)
        self.width = (vectors.max(0, initial=0) - self.least) // CELLS + 1
        self.cells = np.ascontiguousarray(((vectors - self.least) // self.width).astype(np.uint8).T)

    def tables(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By component, cell and anchor the most that the product can be; by anchor how far the least sum lies below the most."""
        low = (self.least[:, None] + np.arange(CELLS) * self.width[:, None])[:, :, None]
        high = low + self.width[:, None, None] - 1
        by_dim = anchors.T[:, None, :]
        tables = np.maximum(by_dim * low, by_dim * high)
        fits = np.abs(tables).max(initial=0) * max(1, len(self.width)) < 2**31 - 1
        return np.ascontiguousarray(tables, np.int32 if fits else np.int64), np.abs(anchors) @ (self.width - 1)

    def most(self, tables: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Upper bounds of the rows from start to stop, by row and anchor."""
        total = np.zeros((stop - start, tables.shape[2]), tables.dtype)
        for table, cells in zip(tables, self.cells):
            total += table[cells[start:stop]]
        return total.astype(np.int64)


def _first(keys: np.ndarray, ids: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` of each key: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -scores, keys))
    sorted_keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < most]


def _scan(anchors: dict, rows: dict, page: Approximation, low: np.ndarray, high: np.ndarray, allowed: Callable, most: int, rising: bool) -> Iterator[tuple]:
    """(places of anchors, windows, ids, scores): the first ``most`` of the allowed rows with a score in each window from low to high (anchor x window).

    rising: the windows have no upper end, so lower bounds already tell the least score that can still count.
    """
    windows = low.shape[1]
    for first in range(0, len(anchors["ids"]), ANCHORS_EACH):
        part = slice(first, first + ANCHORS_EACH)
        vectors, floor, top = anchors["vec"][part], low[part].copy(), high[part]
        tables, slack = page.tables(vectors)
        key, ids, scores = (np.zeros(0, np.int64) for _ in range(3))
        for start in range(0, len(rows["ids"]), ROWS_EACH):
            stop = min(start + ROWS_EACH, len(rows["ids"]))
            upper = page.most(tables, start, stop)
            lower = upper - slack
            may = allowed(slice(start, stop), part)
            if rising and stop - start > most:
                sure = np.partition(np.where(may, lower, _LEAST), stop - start - most, axis=0)[stop - start - most]
                floor[:, 0] = np.maximum(floor[:, 0], sure)
            reaches = np.zeros(upper.shape, bool)
            for w in range(windows):
                reaches |= (upper >= floor[:, w]) & (lower <= top[:, w])
            i, j = np.nonzero(reaches & may)
            exact = np.einsum("ij,ij->i", rows["vec"][start + i], vectors[j])
            for w in range(windows):
                inside = (exact >= floor[j, w]) & (exact <= top[j, w])
                key = np.concatenate([key, j[inside] * windows + w])
                ids = np.concatenate([ids, rows["ids"][start + i[inside]]])
                scores = np.concatenate([scores, exact[inside]])
            kept = _first(key, ids, scores, most)
            key, ids, scores = key[kept], ids[kept], scores[kept]
            full, counts = np.unique(key, return_counts=True)
            last = np.cumsum(counts) - 1  # keys are in order, scores fall within a key
            whole = counts == most
            floor[full[whole] // windows, full[whole] % windows] = np.maximum(floor[full[whole] // windows, full[whole] % windows], scores[last[whole]])
        yield first + key // windows, key % windows, ids, scores


def _sides(left: pa.Table, right: pa.Table) -> tuple[dict, dict, int]:
    wide = max((int(t["vec"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max(initial=0)) for t in (left, right)), default=0)
    anchors, rows = ({"ids": t["vec_id"].to_numpy(), "label": t["label"].to_numpy(), "vec": _matrix(t["vec"], wide)} for t in (left, right))
    return anchors, rows, wide


def _dealt(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int):
    """Anchors and rows grouped by (block, group): a block of anchors meets each group of rows once."""
    spark = rows.sparkSession
    per_group = min(GROUP_MOST, max(GROUP_LEAST, n_rows // (2 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    blocks, groups = -(-n_anchors // ANCHORS) or 1, -(-n_rows // per_group) or 1

    def dealt(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(n_own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    return dealt(anchors, "block", blocks, "grp", groups).groupBy("block", "grp").cogroup(dealt(rows, "grp", groups, "block", blocks).groupBy("block", "grp"))


def positives_of(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, most: int = POSITIVES) -> DataFrame:
    """anchor_id, vec_id, score: the first ``most`` other rows with an anchor's label."""
    schema = pa.schema([("anchor_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            anchors, rows, _ = _sides(left, right)
            for label in np.unique(anchors["label"]):
                a, r = ({k: v[side["label"] == label] for k, v in side.items()} for side in (anchors, rows))
                if len(r["ids"]):
                    low = np.full((len(a["ids"]), 1), _LEAST)
                    for at, _, ids, scores in _scan(a, r, Approximation(r["vec"]), low, np.full(low.shape, np.iinfo(np.int64).max), lambda rs, cs: r["ids"][rs, None] != a["ids"][None, cs], most, True):
                        found.append(pa.table([a["ids"][at], ids, scores], schema=schema))
        return pa.concat_tables(found) if found else schema.empty_table()

    found = _dealt(anchors, rows, n_anchors, n_rows).applyInArrow(search, "anchor_id long, vec_id long, score long")
    own = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("at", F.row_number().over(own)).where(F.col("at") <= most).drop("at")


def negatives_of(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, share: int = SHARE, most: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, positive_score, negative_id, negative_score, rank; anchors come with ``positives``, an array of (score, vec_id)."""
    schema = pa.schema([(n, pa.int64()) for n in ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            a, r, _ = _sides(left, right)
            opened = left["positives"].to_pylist()
            wide = max(map(len, opened))
            score, ids = (np.array([[p[name] for p in row] + [none] * (wide - len(row)) for row in opened], np.int64).reshape(len(opened), wide) for name, none in (("score", -1), ("vec_id", 0)))
            low = -(-share * score // 100)  # above the score where that is negative: an empty window
            for at, window, found_ids, scores in _scan(a, r, Approximation(r["vec"]), low, score, lambda rs, cs: r["label"][rs, None] != a["label"][None, cs], most, False):
                found.append(pa.table([a["ids"][at], ids[at, window], score[at, window], found_ids, scores], schema=schema))
        return pa.concat_tables(found) if found else schema.empty_table()

    found = _dealt(anchors, rows, n_anchors, n_rows).applyInArrow(search, ", ".join(f"{n} long" for n in schema.names))
    own = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= most)


def mine(embeddings: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, share: int = SHARE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of each negative.

    Rows that take part: see ``prepared``; an empty table gives none. Vectors
    of unlike length are compared over the shorter one. Equal scores go by the
    smaller id. Every row is bounded for every anchor; none is left out by a
    sample or a cap. Other columns are ignored.
    """
    rows = shared.cut_lineage(prepared(embeddings))
    anchors = rows.where(F.col("vec_id") % every == 0)
    n_rows, n_anchors = rows.count(), anchors.count()
    first = positives_of(anchors, rows, n_anchors, n_rows, positives)
    opened = first.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("positives"))  # at most ``positives`` each
    opened = shared.cut_lineage(anchors.join(opened.withColumnRenamed("anchor_id", "vec_id"), "vec_id"))
    found = negatives_of(opened, rows, n_anchors, n_rows, share, negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = f"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other_id, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % {EVERY} = 0),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES}),
n AS (
  SELECT p.*, other_id AS negative_id, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND {SHARE} * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
