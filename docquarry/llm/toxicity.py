"""Toxicity by a factorization machine over hashed terms.

A document is the set of its hashed lower-case words. The score is the logistic
of a bias, a weight for each term and, for each pair of terms, the product of
their latent vectors, so that two terms may mean together what neither means
alone. It is fitted with numpy on a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm import shared

#: Labelled documents of each class that the fit uses at most, in the order of a hash of doc_id.
SAMPLE_PER_CLASS = 6000
#: Terms of the model: those that tell the classes apart best, and frequent ones as their context.
TELLING_TERMS, CONTEXT_TERMS = 3000, 200
#: Standard errors that a telling term's shares differ by at least; chosen by cross_validated() on training rows alone (README has the figures).
MIN_ERRORS = 6.5
LATENT = 4
EPOCHS = 60
#: Rows whose gradients are summed at once; it bounds memory and changes nothing else.
FIT_ROWS = 500
THRESHOLD = 0.7
_WORD = re.compile(r"\w+")
#: Words of at most MEMO_LONGEST characters whose place a task keeps; 150 to 350 bytes each.
_MEMO, MEMO_LONGEST = 200_000, 100


@dataclass
class Model:
    bias: float
    terms: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray

    def margins(self, starts: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Margins of rows; row r has the terms index[starts[r]:starts[r + 1]]."""
        w, v = sums(self.weights[index][:, None], starts)[:, 0], self.vectors[index]
        return self.bias + w + 0.5 * (sums(v, starts) ** 2 - sums(v**2, starts)).sum(1)

    def score(self, starts: np.ndarray, index: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(starts, index), -30, 30)))


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the rows of values between one start and the next, each by itself: equal rows give equal sums whatever stands beside them."""
    out = np.zeros((starts.size - 1, values.shape[1]))
    some = np.flatnonzero(np.diff(starts))
    if some.size:
        out[some] = np.add.reduceat(values.astype(np.float64), starts[some], axis=0)
    return out


def terms_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def hashed(text: str | None) -> np.ndarray:
    return np.unique(np.fromiter((zlib.crc32(w.encode()) for w in terms_of(text)), np.uint32))


def training_labels(labels: DataFrame) -> DataFrame:
    """Labelled ids from which the fit may learn: crc32(doc_id as text) mod 3 is not 1. One row an id; ids with both labels are toxic."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    return known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~is_held_out("doc_id"))


def is_held_out(column: str):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1


def sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> list[tuple[int, np.ndarray]]:
    """(label, hashed terms) of at most per_class documents of each class.

    Of texts that share a doc_id the one with the greatest terms is taken, so
    that the bound on labelled ids bounds the rows; equal term sets count once.
    """
    train = training_labels(labels)
    order = F.xxhash64("doc_id")
    picked = train.where("toxic = 1").orderBy(order, "doc_id").limit(per_class).unionByName(train.where("toxic = 0").orderBy(order, "doc_id").limit(per_class))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = texts.join(F.broadcast(picked), "doc_id")  # at most 2 * per_class rows of two numbers
    arrow = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("terms", pa.binary())])

    def hash_all(doc_ids: list, texts: list, toxic: list) -> dict:
        return {"doc_id": doc_ids, "toxic": toxic, "terms": [hashed(t).tobytes() for t in texts]}

    rows = shared.map_texts(chosen, hash_all, "doc_id long, toxic int, terms binary", arrow, [F.col(c) for c in ("doc_id", "text", "toxic")])
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("terms").alias("terms"))  # one row an id
    found = sorted({(bytes(r.terms), r.toxic) for r in rows.collect()})  # copies count once
    return [(toxic, np.frombuffer(terms, np.uint32)) for terms, toxic in found]


def choose_terms(rows: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """The terms whose document shares differ most between the classes, by standard errors, and the most frequent ones."""
    n = np.array([sum(y == k for y, _ in rows) for k in (0, 1)], float)
    parts = [np.concatenate([t for y, t in rows if y == k] or [np.zeros(0, np.uint32)]) for k in (0, 1)]
    terms, index = np.unique(np.concatenate(parts), return_inverse=True)
    counts = np.array([np.bincount(x, minlength=terms.size) for x in np.split(index, [parts[0].size])], float)
    shares = (counts + 0.5) / (n[:, None] + 1)
    pooled = counts.sum(0) / n.sum()
    error = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-9) * (1 / (n[0] + 1) + 1 / (n[1] + 1)))
    telling = np.where((counts.sum(0) >= 4) & (shares.max(0) >= 3 * shares.min(0)), np.abs(shares[1] - shares[0]) / error, 0)
    best = np.argsort(-telling, kind="stable")[:TELLING_TERMS]
    often = np.argsort(-counts.sum(0), kind="stable")[:CONTEXT_TERMS]
    return np.unique(np.concatenate([terms[best[telling[best] > MIN_ERRORS]], terms[often]]))


def fit(rows: list[tuple[int, np.ndarray]], seed: int = 0) -> Model:
    """Full-batch Adam on the logistic loss, classes weighted alike; without both classes the scores are the label's share, or 0."""
    y = np.array([r[0] for r in rows], float)
    if not len(rows) or y.min() == y.max():
        share = float(y.mean()) if len(rows) else 0.0
        return Model(np.log((share + 1e-6) / (1 - share + 1e-6)), np.zeros(0, np.uint32), np.zeros(0), np.zeros((0, LATENT)))
    terms = choose_terms(rows)
    starts, index = lookup(terms, [t for _, t in rows])
    rng = np.random.default_rng(seed)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    model = Model(0.0, terms, np.zeros(terms.size), rng.normal(0, 0.01, (terms.size, LATENT)))
    params = [np.zeros(1), model.weights, model.vectors]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, EPOCHS + 1):
        model.bias = float(params[0][0])
        grads = [np.zeros(1), 2e-5 * model.weights, 1e-4 * model.vectors]
        for first in range(0, len(rows), FIT_ROWS):
            own = starts[first : first + FIT_ROWS + 1]
            part, own = index[own[0] : own[-1]], own - own[0]
            gap = weight[first : first + FIT_ROWS] * (model.score(own, part) - y[first : first + FIT_ROWS])
            owner, v = np.repeat(np.arange(own.size - 1), np.diff(own)), model.vectors[part]
            pull = gap[owner][:, None] * (sums(v, own)[owner] - v)
            grads[0] += gap.sum()
            grads[1] += np.bincount(part, gap[owner], terms.size)
            grads[2] += np.stack([np.bincount(part, pull[:, k], terms.size) for k in range(LATENT)], axis=1)
        for p, g, (m, s) in zip(params, grads, moments):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            p -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    model.bias = float(params[0][0])
    return model


def cross_validated(rows: list[tuple[int, np.ndarray]], folds: int = 4) -> tuple[float, int, int]:
    """Mean log loss, toxic rows missed and others flagged at THRESHOLD, each row by a fit on the other folds; equal term sets share a fold."""
    fold = np.array([zlib.crc32(t.tobytes()) % folds for _, t in rows])
    loss, missed, flagged = 0.0, 0, 0
    for f in range(folds):
        model = fit([r for r, g in zip(rows, fold) if g != f])
        held = [r for r, g in zip(rows, fold) if g == f]
        if held:
            y, p = np.array([r[0] for r in held]), model.score(*lookup(model.terms, [t for _, t in held]))
            loss -= float(np.log(np.where(y == 1, p, 1 - p)).sum())
            missed, flagged = missed + int(((p < THRESHOLD) & (y == 1)).sum()), flagged + int(((p >= THRESHOLD) & (y == 0)).sum())
    return loss / max(1, len(rows)), missed, flagged


def lookup(terms: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and indexes into sorted ``terms`` of the rows' known terms."""
    sizes, found = [0], []
    for t in rows:
        at = np.searchsorted(terms, t)
        at = at[(at < terms.size) & (terms[np.minimum(at, max(terms.size - 1, 0))] == t)] if terms.size else at[:0]
        found.append(at)
        sizes.append(at.size)
    return np.cumsum(sizes), np.concatenate(found) if found else np.zeros(0, np.int64)


def scorer(model: Model) -> Callable[[list], np.ndarray]:
    """The function from texts to scores; its ``done`` drops what it keeps of words."""
    places = {int(t): i for i, t in enumerate(model.terms)}
    memo: list[_Places] = []

    def scores(texts: list) -> np.ndarray:
        memo or memo.append(_Places(places))
        rows = []
        for t in texts:
            words = terms_of(t)
            at = np.fromiter(map(memo[0].__getitem__, words), np.int64, len(words))
            rows.append(np.unique(at[at >= 0]))
        starts = np.cumsum([0, *map(len, rows)])
        return model.score(starts, np.concatenate(rows) if rows else np.zeros(0, np.int64))

    scores.done = memo.clear
    return scores


class _Places(dict):
    """From a word to its term's place in the model, or -1; bounded by _MEMO."""

    def __init__(self, places: dict[int, int]):
        super().__init__()
        self.places = places

    def __missing__(self, word: str) -> int:
        at = self.places.get(zlib.crc32(word.encode()), -1)
        if len(self) < _MEMO and len(word) <= MEMO_LONGEST:
            self[word] = at
        return at


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row, from its whole text alone.

    Null and empty texts get the score of no terms; equal texts get equal
    scores, and one of exactly THRESHOLD counts as toxic. Repeated rows and null
    ids (not held out) stay; other columns are ignored. Whole texts count, however long, each in one task;
    an empty table gives no rows.
    """
    arrow = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    scores = scorer(model)
    scored = shared.map_texts(docs, lambda ids, texts: {"doc_id": ids, "score": scores(texts)}, "doc_id long, score double", arrow, done=scores.done)
    return scored.select("doc_id", F.coalesce(is_held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with a score under THRESHOLD, with all their columns, whatever these are called; repeated rows and null ids stay or go as any others."""
    scores = scorer(model)
    return shared.filter_texts(docs, lambda texts: (scores(texts) < THRESHOLD).tolist(), done=scores.done)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(sample(docs, labels))
