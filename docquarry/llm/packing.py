"""Best-fit packing of token pieces into sequences of a fixed length.

Bulk-synchronous best-fit: documents and gaps are sorted by size, each document
meets its successor (the tightest gap that holds it), conflicts for a gap go by
rank, gaps shrink, and the steps repeat.

Lengths are whole numbers up to the capacity, so the sorted order of all
documents is a list of at most ``capacity`` runs of equal length, and so is that
of gaps. A step sweeps one run of documents over the runs of gaps. The state is
bounded by the capacity, never by the corpus, so the driver holds it. Ranks are
given out in parallel, with each length dealt over salts, and every row finds
its sequence by (length, rank).
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm import bpe, shared

CAPACITY = 1024
#: Id that ends each document.
END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def token_pieces(docs: DataFrame, tokenizer: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces of the documents, each of at most ``capacity`` ids; null text counts as empty.

    A document is its ids and ``end_id``. A longer one is cut into full pieces;
    what is left over comes first. With keep_ids the ids are returned as a
    binary of little-endian unsigned 32-bit integers. Texts of any length are
    encoded whole; repeated rows and null ids give pieces of their own; other
    columns are ignored.
    """

    def cut(doc_ids: list, texts: list) -> dict:
        vocabulary, end = bpe.from_json(tokenizer, pattern), np.array([end_id], dtype="<u4").tobytes()
        out: dict[str, list] = defaultdict(list)
        for doc_id, text in zip(doc_ids, texts):
            ids = vocabulary.packed_ids(text or "") + end
            n = len(ids) // 4
            start = 0
            for piece in range(-(-n // capacity)):
                stop = n - (-(-n // capacity) - 1 - piece) * capacity
                own = ids[4 * start : 4 * stop]
                for k, v in (("doc_id", doc_id), ("piece", piece), ("start", start), ("length", stop - start), ("ids_crc32", zlib.crc32(own))):
                    out[k].append(v)
                if keep_ids:
                    out["ids"].append(own)
                start = stop
        return out

    done = lambda: bpe.from_json(tokenizer, pattern).words.clear()
    if keep_ids:
        return shared.map_texts(docs, cut, PIECES + ", ids binary", _ARROW.append(pa.field("ids", pa.binary())), done=done)
    return shared.map_texts(docs, cut, PIECES, _ARROW, done=done)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset) for runs of documents of one length; as best-fit decreasing places them one by one.

    A step takes the next run of documents, the longest left, and sweeps over the
    runs of gaps from its successor on. A document goes to the tightest gap, and
    the next of its length to the same one as long as it fits, so each gap of a
    run takes equally many, in the order of ranks, and shrinks; what no gap holds
    opens sequences. A step splits at most one run of gaps and opens at most two.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    placed, sequences = [], 0

    def add_gap(size: int, first: int, count: int) -> None:
        if size and count:
            if size not in gaps:
                gaps[size] = []
                insort(sizes, size)
            gaps[size].append((first, count))

    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        left, shrunk = counts[length], []

        def fill(size: int, first: int, count: int) -> tuple[int, int]:
            """Puts documents into gaps of a run, as many as fit each; how many documents are placed, and in how many gaps."""
            each, rank = size // length, counts[length] - left
            whole = min(count, left // each)
            over = left - whole * each if whole < count else 0  # fewer than fit the next gap
            for take, start, bins in ((each, first, whole), (over, first + whole, int(over > 0))):
                for k in range(take if bins else 0):  # the k-th document of each of these gaps
                    placed.append((length, rank, bins, start, capacity - size + k * length))
                    rank += bins
                if bins:
                    shrunk.append((size - take * length, start, bins))
            return whole * each + over, whole + int(over > 0)

        at = bisect_left(sizes, length)
        while left and at < len(sizes):
            first, count = gaps[sizes[at]].pop()
            done, used = fill(sizes[at], first, count)
            left -= done
            if used < count:
                gaps[sizes[at]].append((first + used, count - used))
            if not gaps[sizes[at]]:
                del gaps[sizes.pop(at)]
        if left:
            done, used = fill(capacity, sequences, left)
            left, sequences = left - done, sequences + used
        for gap in shrunk:
            add_gap(*gap)
    return placed


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, length and any other columns) with sequence_id and offset.

    Lengths must be from 1 to capacity. Repeated rows and null ids are placed
    like any others; an empty table gives an empty one. Columns named
    sequence_id or offset are replaced.
    """
    spark = pieces.sparkSession
    salts = max(16, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    dealt = shared.cut_lineage(pieces.select(*names).withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int")))
    counts = dealt.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("length").orderBy("__salt")) - F.col("__n")
    ahead = counts.select("length", "__salt", before.alias("__before"))
    runs = {r[0]: r[1] for r in dealt.groupBy("length").count().collect()}  # at most ``capacity`` rows
    placed = sorted(plan(runs, capacity))
    within = F.row_number().over(Window.partitionBy("length", "__salt").orderBy("doc_id", "piece"))
    ranked = dealt.join(ahead, ["length", "__salt"]).withColumn("__rank", F.col("__before") + within - 1)
    # Runs are at most a few for each pair of a length and a gap: their number depends on the capacity alone.
    keys = np.array([[n, r] for n, r, *_ in placed], dtype=np.int64).reshape(-1, 2)
    values = np.array([[s, o, r] for _, r, _, s, o in placed], dtype=np.int64).reshape(-1, 3)
    key = keys[:, 0] * (1 << 48) + keys[:, 1]

    def place(batches):
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            rank = columns.pop("__rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, columns["length"].to_numpy(zero_copy_only=False) * (1 << 48) + rank, side="right") - 1
            columns["sequence_id"] = pa.array(values[at, 0] + rank - values[at, 2], pa.int64())
            columns["offset"] = pa.array(values[at, 1], pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    ranked = ranked.select(*names, "__rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "__rank")
    return ranked.mapInArrow(place, schema + ", sequence_id long, offset long")
