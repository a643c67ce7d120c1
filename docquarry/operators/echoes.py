"""Sentences that nearly repeat a table row of their page, by a join with bounds before exact ratios.

Sentences and rows meet by page, in blocks where a page is large, so no task
holds more than a block of each. Counts of hashed tokens and of hashed pairs of
neighbouring letters bound the token-set ratio of a pair from above; only pairs
whose bounds reach it are compared letter by letter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions import subsequences
from docquarry.plans.shared_folder import cut_lineage

#: Lines of a block; lines of several blocks that a task bounds at once; pairs bounded, and compared, at once.
BLOCK, LINES, PAIRS, EXACT = 2_000, 4_000, 10_000, 20_000
_SLOTS = 256
#: Pages of several blocks whose sizes are sent to all tasks; more of them are joined.
BROADCAST_PAGES = 10_000
_PAIR = "struct<left_block:int,right_block:int,s:boolean>"
_KEYS = ["doc_id", "page", "left_block", "right_block"]


class Lines:
    """Distinct lines with the counts that bound their ratios."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}

    def number(self, text: str) -> int:
        return self.at.setdefault(text, len(self.at))

    def count(self) -> None:
        self.tokens = [set(t.split()) for t in self.at]
        joined = [" ".join(t) for t in self.tokens]
        self.length = np.array([len(j) for j in joined], np.int64)
        letters = np.frombuffer("\n".join(joined).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        line = np.repeat(np.arange(len(joined)), self.length + 1)[: len(letters)]
        inner = (letters != 32) & (letters != 10)
        pairs = np.flatnonzero(inner[:-1] & inner[1:])
        hashed = (letters[pairs] * 31 + letters[pairs + 1] * 7) % _SLOTS
        self.pairs = np.bincount(line[pairs] * _SLOTS + hashed, minlength=len(joined) * _SLOTS).reshape(-1, _SLOTS).astype(np.int32)
        self.n_pairs = self.pairs.sum(1)
        opens = inner.copy()
        opens[1:] &= ~inner[:-1]
        starts = np.flatnonzero(opens)
        own = (np.cumsum(opens) - 1)[inner]
        offset = np.flatnonzero(inner) - starts[own]
        mixed = np.bincount(own, letters[inner] * (offset % 8 * 2 + 1) % 1021, minlength=len(starts)).astype(np.int64) % _SLOTS
        sizes = np.bincount(own, minlength=len(starts))
        # a token weighs its length and the space before it
        self.weights = np.bincount(line[starts] * _SLOTS + mixed, sizes + 1, minlength=len(joined) * _SLOTS).reshape(-1, _SLOTS).astype(np.int32)

    def may_be_alike(self, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
        """False only where the token-set ratio of two lines is certainly below ``least``."""
        a, b = self.length[i], self.length[j]
        short = np.minimum(a, b)
        shared = np.minimum(self.weights[i], self.weights[j]).sum(1) - 1  # at least the length of the shared tokens joined
        may = (shared >= short * least / (200 - least) - 1e-6) | (a + b == 0)
        rest = np.flatnonzero(~may & (200.0 * short >= least * (a + b) - 1e-6))
        # with d letters left over, a letter left out breaks two neighbouring pairs of its own line and one of the other
        i, j, a, b = i[rest], j[rest], a[rest], b[rest]
        left_over = (a + b) * (1 - least / 100)
        needed = np.maximum(self.n_pairs[i] - (a - b) / 2, self.n_pairs[j] + (a - b) / 2) - 1.5 * left_over
        may[rest] = np.minimum(self.pairs[i], self.pairs[j]).sum(1) >= needed - 1e-6
        return may

    def alike(self, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
        """Whether the token-set ratio is at least ``least``: by the shared tokens alone, or by both sides whole, which begin with them."""
        said = np.zeros(len(i), bool)
        open_pairs, rests, starts = [], [], []
        for k, (a, b) in enumerate(zip(i.tolist(), j.tolist())):
            x, y = self.tokens[a], self.tokens[b]
            n, m = int(self.length[a]), int(self.length[b])
            same = x & y
            both = sum(map(len, same)) + len(same) - 1 if same else 0
            if same and (len(same) == len(x) or len(same) == len(y)) or both and 200.0 * both / (both + min(n, m)) >= least or n + m == 0:
                said[k] = True
            elif 200.0 * min(n, m) / (n + m) >= least:
                open_pairs.append(k)
                rests.append((" ".join(sorted(x - same)), " ".join(sorted(y - same))))
                starts.append(both + bool(same))
        if rests:
            common = np.array(starts) + subsequences.common_lengths(rests)
            said[open_pairs] = 200.0 * common / (self.length[i[open_pairs]] + self.length[j[open_pairs]]) >= least
        return said


def _candidates(groups: list[tuple[dict, dict]], lines: Lines, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of a group, lines of sentences, lines of rows): the pairs of a group that their bounds leave open."""
    for number, (sentences, rows) in enumerate(groups):
        row_lines = np.array(sorted(rows, key=rows.__getitem__), np.int64)
        places = np.array([rows[r] for r in row_lines.tolist()], np.float64)
        # a row after the last sentence of its kind, or after a row that says the same, tells nothing
        own = np.array(list(sentences), np.int64)
        counts = np.searchsorted(places, [min(max(sentences[s]), rows.get(s, np.inf)) for s in own.tolist()])
        ends = np.cumsum(counts)
        for start in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
            pair = np.arange(start, min(start + PAIRS, ends[-1]))
            at = np.searchsorted(ends, pair, side="right")
            i, j = own[at], row_lines[pair - ends[at] + counts[at]]
            may = lines.may_be_alike(i, j, least)
            yield number, i[may], j[may]


def _first_echoes(groups: list[tuple[dict, dict]], lines: Lines, least: float) -> list[dict]:
    """For each group (line of a sentence to its places, line of a row to its first place) the first place of an alike row by line."""
    lines.count()
    first = [{s: rows[s] for s in sentences if s in rows} for sentences, rows in groups]
    held: list[tuple[int, np.ndarray, np.ndarray]] = []

    def settle() -> None:
        number = np.repeat([n for n, _, _ in held], [len(i) for _, i, _ in held])
        i, j = (np.concatenate([h[k] for h in held]) for k in (1, 2))
        hits = np.flatnonzero(lines.alike(i, j, least))
        for n, s, r in zip(number[hits].tolist(), i[hits].tolist(), j[hits].tolist()):
            first[n][s] = min(first[n].get(s, np.inf), groups[n][1][r])
        held.clear()

    size = 0
    for found in _candidates(groups, lines, least):
        held.append(found)
        size += len(found[1])
        if size >= EXACT:
            settle()
            size = 0
    if held:
        settle()
    return first


def _dealt(both: DataFrame, sizes: DataFrame | None) -> DataFrame:
    """Lines with the pairs of blocks (left_block, right_block) that they go to, as a sentence, as a row or, in a page of one block, as both."""
    if sizes is None:
        return both.withColumns({"left_block": F.lit(0), "right_block": F.lit(0)})
    block = lambda n: F.pmod(F.xxhash64("text"), n).cast("int")  # noqa: E731  equal texts meet
    each = lambda role, n, pair: F.when(F.col(role), F.transform(F.sequence(F.lit(0), n - 1), pair)).otherwise(F.array().cast(f"array<{_PAIR}>"))
    pair = lambda left, right, sentence: F.struct(left.alias("left_block"), right.alias("right_block"), F.lit(sentence).alias("s"))
    lefts, rights = F.col("lefts"), F.col("rights")
    pairs = F.concat(each("sentence", rights, lambda k: pair(block(lefts), k, True)), each("row", lefts, lambda k: pair(k, block(rights), False)))
    same = [both["doc_id"].eqNullSafe(sizes["doc_id"]), both["page"].eqNullSafe(sizes["page"])]
    own = both.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_PAGES else sizes, same).drop(sizes["doc_id"], sizes["page"])
    return own.withColumn("pair", F.explode(pairs)).select("doc_id", "page", "pos", "text", F.col("pair.s").alias("sentence"), (~F.col("pair.s")).alias("row"), "pair.left_block", "pair.right_block")


def without_echoes(sentences: DataFrame, rows: DataFrame | None, least: float) -> DataFrame:
    """The sentences (doc_id, page, pos, text) that no row (doc_id, page, text) of their page nearly repeats.

    Where rows have a ``pos`` too, only those before a sentence count. Without
    rows the sentences are their own. Null texts and empty rows are like
    nothing, and equal sentences of a place share their fate.
    """
    own = sentences.select("doc_id", "page", "pos", "text")
    placed = rows is None or "pos" in rows.columns
    if rows is None:
        both = own.withColumns({"sentence": F.lit(True), "row": F.coalesce(F.col("text") != "", F.lit(False))})
    else:
        others = rows.select("doc_id", "page", (F.col("pos") if placed else F.lit(None)).cast(dict(own.dtypes)["pos"]).alias("pos"), "text", F.lit(False).alias("sentence"), F.lit(True).alias("row"))
        both = own.withColumns({"sentence": F.lit(True), "row": F.lit(False)}).unionByName(others.where("text <> ''"))
    sizes = both.groupBy("doc_id", "page").agg(*(F.greatest(F.ceil(F.count_if(role) / BLOCK), F.lit(1)).cast("int").alias(name) for name, role in (("lefts", "sentence"), ("rights", "row"))))
    large = cut_lineage(sizes.where("lefts > 1 or rights > 1"))
    # pages of one block in one pass; those of more say by block what goes
    if large.isEmpty():
        return _compared(_dealt(both, None), placed, least, kept=True)
    pages = F.broadcast(large) if large.count() <= BROADCAST_PAGES else large
    in_page = lambda df: df["doc_id"].eqNullSafe(pages["doc_id"]) & df["page"].eqNullSafe(pages["page"])
    small = _compared(_dealt(both.join(pages, in_page(both), "left_anti"), None), placed, least, kept=True)
    gone = _compared(_dealt(both, large), placed, least, kept=False).distinct()
    wide = own.join(pages, in_page(own), "left_semi")
    same = [wide[c].eqNullSafe(gone[c]) for c in ("doc_id", "page", "pos")]
    return small.unionByName(wide.join(gone, [*same, F.xxhash64(wide["text"]) == gone["digest"]], "left_anti"))


def _compared(dealt: DataFrame, placed: bool, least: float, kept: bool) -> DataFrame:
    """The sentences that stay, or (doc_id, page, pos, digest) of those that go, by pair of blocks."""
    kinds = dict(dealt.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", "page", "pos")) + (f", text {kinds['text']}" if kept else ", digest long")
    names = ["doc_id", "page", "pos", "text" if kept else "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, held, lines, key, types = [], [], Lines(), None, []

        def found() -> Iterator[pa.RecordBatch]:
            out: list[list] = [[] for _ in names]
            for own, first in zip(held, _first_echoes(groups, lines, least)):
                for doc_id, page, pos, last, line in own:
                    echo = line is not None and first.get(line, np.inf) < (np.inf if pos is None or not placed else pos)
                    if echo != kept:
                        for column, value in zip(out, (doc_id, page, pos, last)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

        for batch in batches:
            types = [batch.schema.field(n).type for n in names]
            for doc_id, page, pos, text, digest, sentence, row, lb, rb in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "page", "pos", "text", "digest", "sentence", "row", "left_block", "right_block"))):
                if (doc_id, page, lb, rb) != key:
                    if len(lines.at) >= LINES:
                        yield from found()
                        groups, held, lines = [], [], Lines()
                    key = (doc_id, page, lb, rb)
                    groups.append(({}, {}))
                    held.append([])
                number = None if text is None else lines.number(text)
                if row:
                    place = -np.inf if pos is None or not placed else pos
                    groups[-1][1][number] = min(place, groups[-1][1].get(number, np.inf))
                if sentence:
                    held[-1].append((doc_id, page, pos, text if kept else digest, number))
                    if number is not None:
                        groups[-1][0].setdefault(number, []).append(np.inf if pos is None or not placed else pos)
        if groups:
            yield from found()

    own = dealt.withColumn("digest", F.lit(0) if kept else F.xxhash64("text"))
    return own.repartition(*_KEYS).sortWithinPartitions(*_KEYS).mapInArrow(run, schema)
