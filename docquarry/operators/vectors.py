"""A stored index of vectors: coarse cells by k-means, points kept by cell, exact scores in the cells that a query probes.

Three upserted tables: cells (cell, center, n, least), points (cell, id,
embedding) in buckets of the cell, and places (id, cell, near) that tell where a
changed point was. Cells are fitted once, on a bounded sample; every point is
placed. A cell keeps the least cosine of its points to its center, which bounds
the score of any of them, so that a search can also be exact.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.operators.search import QUERY_BLOCK
from docquarry.plans.shared_folder import cut_lineage
from docquarry.sources.upserts import Folder, UpsertTable

#: Buckets of cells, and tasks that write one.
BUCKETS, FILES = 32, 2
#: The most cells, and points of the sample for each.
MOST_CELLS, SAMPLE = 1024, 64
#: Points that one group scores; a larger cell is dealt over several.
SLICE = 20_000
#: Cells that an exact search probes first.
FIRST_PROBES = 8
#: The part of the hits that the probed cells are to hold, and points that are asked to tell how many cells that takes.
RECALL, ASKED = 0.95, 200
#: Scores are rounded to 6 places, so a bound may lie that much below the last score that counts.
SLACK = 2e-6
CENTERS = "cell int, center array<double>"


def usable(vector: Column) -> Column:
    """Whether a vector is there and has finite components only."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & (F.size(vector) > 0)


def _unit(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows of length one; short vectors are filled with zeros, long ones cut, and zero vectors stay."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        v = np.asarray(v, float)[:width]
        out[i, : len(v)] = v
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


class VectorIndex:
    """An index under ``path``; ids are whole numbers, and vectors have the width of those it was fitted on."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, files: int = FILES, slice_size: int = SLICE):
        self.spark, self.path, self.folder, self.slice_size = spark, path, Folder(spark, path), slice_size
        self.cells = UpsertTable(spark, f"{path}/cells", ["cell"], buckets=1)
        self.points = UpsertTable(spark, f"{path}/points", ["cell", "id"], buckets=buckets, by=["cell"], files=files)
        self.places = UpsertTable(spark, f"{path}/places", ["id"], buckets=buckets)
        self._probes: dict[tuple, int] = {}

    def _fitted(self, points: DataFrame) -> pd.DataFrame:
        """(cell, center): at most MOST_CELLS rows. Fitted by the first batch with points, on about SAMPLE of them a cell, chosen by a hash of the id."""
        if self.folder.exists("centers/_SUCCESS"):
            return self.spark.read.parquet(f"{self.path}/centers").toPandas().sort_values("cell", ignore_index=True)
        own = points.where(F.exists("embedding", lambda x: x != 0))
        n, width = own.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
        k = max(2, min(MOST_CELLS, round(math.sqrt(n))))
        padded = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.get("embedding", i).cast("double"), F.lit(0.0)))
        part = max(1, math.ceil(min(1.0, SAMPLE * k / max(1, n)) * 1_000_000))
        chosen = cut_lineage(own.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < part).select(array_to_vector(padded).alias("features")))
        centers = KMeans(k=k, seed=7, maxIter=10, distanceMeasure="cosine").fit(chosen).clusterCenters() if chosen.count() > 1 else [np.ones(width)]
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(centers)]
        if n:
            self.spark.createDataFrame(rows, CENTERS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centers")
        return pd.DataFrame(rows, columns=["cell", "center"])

    def refitted(self, path: str) -> VectorIndex:
        """A new index under ``path`` of the same points with cells of its own, for a collection that has outgrown its first batch."""
        new = VectorIndex(self.spark, path, self.points.buckets, self.points.files, self.slice_size)
        new.add(self.points.read().select("id", "embedding"))
        return new

    def add(self, points: DataFrame, gone: DataFrame | None = None, batch: int | None = None) -> None:
        """Take points (id, embedding) in, in the place of those of the same id, and those of ``gone`` (id) out.

        Of several vectors of one id the greatest counts. Points without an id,
        or with a null, empty or non-finite vector, are left out. Batches count
        up from 0; one that comes again changes nothing, and one that was lost
        is repeated from what it had staged.
        """
        done = self.cells.manifest()
        batch = (done.writers["add"] + 1 if done else 0) if batch is None else batch
        if done and done.writers["add"] >= batch:
            return
        staging = f"staging/{batch:010d}"
        own = points.where(F.col("id").isNotNull() & usable(F.col("embedding"))).groupBy(F.col("id").cast("long").alias("id")).agg(F.max("embedding").alias("embedding"))
        centers = self._fitted(own)
        placed = self._staged(f"{staging}/placed", own.withColumn("at", _nearest(centers)("embedding")).select("id", "embedding", "at.cell", "at.near"))
        old, removed = self.places.read(), None
        if old is not None:
            moved = old.join(placed.select("id", F.col("cell").alias("now")), "id").where("cell <> now")
            left = moved.select("cell", "id")
            if gone is not None:
                gone = gone.select(F.col("id").cast("long").alias("id")).distinct().join(placed.select("id"), "id", "left_anti")
                left = left.unionByName(old.join(gone, "id", "left_semi").select("cell", "id"))
            removed = self._staged(f"{staging}/removed", left)
        mine = {"writer": "add", "batch": batch}
        self.points.commit(placed.select("cell", "id", "embedding"), removed, distinct=True, **mine)
        self.places.commit(placed.select("id", "cell", "near"), gone if old is not None else None, distinct=True, **mine)
        sizes = self.places.read().groupBy("cell").agg(F.count("*").alias("n"), F.min("near").alias("least"))
        every = self.spark.createDataFrame([(int(c), [float(x) for x in v]) for c, v in zip(centers["cell"], centers["center"])], CENTERS).join(sizes, "cell", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        self.cells.commit(every, distinct=True, **mine)
        self.folder.drop(staging)

    def _staged(self, name: str, rows: DataFrame) -> DataFrame:
        if not self.folder.exists(f"{name}/_SUCCESS"):
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def topk(self, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False) -> DataFrame:
        """(query_id, id, score, rank) of the k nearest points by cosine, rounded to 6 places, ties by id, of queries (query_id, vector).

        Only the nearest cells are read, ``probes`` of them or as many as
        ``probes_for`` finds. exact: then also each cell whose bound reaches the last score found, which
        gives what a scan of all points gives. Unusable vectors have no hits.
        """
        cells = self.cells.read().where("n > 0").toPandas().sort_values("cell", ignore_index=True)  # at most MOST_CELLS
        asked = cut_lineage(queries.where(F.col("query_id").isNotNull() & usable(F.col("vector"))).select(F.col("query_id").cast("long").alias("query_id"), "vector"))
        blocks = max(1, -(-asked.count() // QUERY_BLOCK))
        asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
        first = probes or (FIRST_PROBES if exact else self.probes_for(k))
        near = asked.withColumn("cells", _probed(cells, first)("vector", F.lit(2.0)))
        found = self._scored(near, cells, k)
        if exact and first < len(cells):
            found = cut_lineage(found)
            last = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(-2.0)).alias("last"))
            rest = asked.join(last, "query_id", "left").withColumn("cells", _probed(cells, first, rest=True)("vector", F.coalesce("last", F.lit(-2.0)))).drop("last")
            found = _best(found.unionByName(self._scored(rest, cells, k)), k)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", rank)

    def probes_for(self, k: int, recall: float = RECALL) -> int:
        """The least number of nearest cells that hold this part of the exact hits of ASKED points, those with the least hash of their id; measured once a version."""
        key = (k, recall, self.cells.manifest().version)
        if key not in self._probes:
            cells = self.cells.read().where("n > 0").toPandas().sort_values("cell", ignore_index=True)
            asked = self.points.read().orderBy(F.xxhash64("id"), "id").limit(ASKED).select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
            asked = cut_lineage(asked.withColumn("cells", _probed(cells, len(cells))("vector", F.lit(2.0))))
            hits = self.topk(asked, k, exact=True).join(self.places.read().select("id", "cell"), "id").join(asked.select("query_id", "cells"), "query_id")
            counts = dict(hits.groupBy(F.array_position("cells", F.col("cell")).alias("place")).count().collect())  # at most a row a cell
            total, seen, need = sum(counts.values()), 0, 1
            for place in sorted(counts):
                if seen >= recall * total:
                    break
                seen, need = seen + counts[place], int(place)
            self._probes[key] = need
        return self._probes[key]

    def _scored(self, asked: DataFrame, cells: pd.DataFrame, k: int) -> DataFrame:
        """(query_id, id, score) of the k best points of each query in its ``cells``. A group is a slice of a cell with a block of its queries."""
        wanted = asked.select("query_id", "vector", "block", F.explode("cells").alias("cell"))
        sizes = F.broadcast(self.spark.createDataFrame([(int(c), -(-int(n) // self.slice_size)) for c, n in zip(cells["cell"], cells["n"])], "cell int, slices int"))
        wanted = cut_lineage(wanted.join(sizes, "cell"))
        held = self.points.read(only=self.points.buckets_of(wanted.select("cell"))).join(sizes, "cell")
        dealt = held.withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int")).join(wanted.select("cell", "block").distinct(), "cell")
        spread = wanted.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        width = len(cells["center"].iloc[0]) if len(cells) else 1
        key = ("cell", "block", "slice")

        def score(points: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            out = {"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)}
            if len(points) and len(own):
                ids = points["id"].to_numpy(np.int64)
                scores = np.round(_unit(own["vector"], width) @ _unit(points["embedding"], width).T, 6) + 0.0
                order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
                out = {"query_id": np.repeat(own["query_id"].to_numpy(np.int64), order.shape[1]), "id": ids[order].ravel(), "score": np.take_along_axis(scores, order, 1).ravel()}
            return pd.DataFrame(out)

        each = dealt.select(*key, "id", "embedding").groupBy(*key).cogroup(spread.select(*key, "query_id", "vector").groupBy(*key))
        return _best(each.applyInPandas(score, "query_id long, id long, score double"), k)


def _best(hits: DataFrame, k: int) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return hits.withColumn("at", at).where(F.col("at") <= k).drop("at")


def _nearest(centers: pd.DataFrame):
    """The nearest cell of a vector and the cosine to its center; a zero vector lies in the first cell, at a right angle to all."""
    width = len(centers["center"].iloc[0])
    units, cells = _unit(centers["center"], width), centers["cell"].to_numpy()

    @F.pandas_udf("cell int, near double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        scores = _unit(vectors, width) @ units.T
        return pd.DataFrame({"cell": cells[scores.argmax(1)], "near": scores.max(1)})

    return nearest


def _probed(cells: pd.DataFrame, first: int, rest: bool = False):
    """The ``first`` cells by the cosine of their centers, or with ``rest`` those after them that may hold a score of at least ``last``."""
    width = len(cells["center"].iloc[0]) if len(cells) else 1
    units, names = _unit(cells["center"], width), cells["cell"].to_numpy()
    spread = np.arccos(np.clip(cells["least"].to_numpy(float), -1, 1))

    @F.pandas_udf("array<int>")
    def probed(vectors: pd.Series, last: pd.Series) -> pd.Series:
        near = _unit(vectors, width) @ units.T
        order = np.argsort(-near, axis=1, kind="stable")
        if not rest:
            return pd.Series([names[o[:first]] for o in order])
        # a point at most ``spread`` off its center is at least the rest of the angle off the query
        bound = np.cos(np.maximum(0, np.arccos(np.clip(near, -1, 1)) - spread))
        return pd.Series([names[[c for c in o[first:] if b[c] + SLACK >= x]] for o, b, x in zip(order, bound, last)])

    return probed
