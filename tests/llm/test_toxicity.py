import os
import zlib

import numpy as np
import pytest

from docquarry.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_margins_equal_the_pairwise_sum():
    rng = np.random.default_rng(0)
    m = toxicity.Model(0.3, np.arange(9, dtype=np.uint32), rng.normal(size=9), rng.normal(size=(9, 3)))
    rows = [np.array([0, 3, 7]), np.array([], int), np.array([1, 2, 4, 8])]
    starts = np.cumsum([0, *map(len, rows)])
    want = [0.3 + m.weights[r].sum() + sum(m.vectors[a] @ m.vectors[b] for i, a in enumerate(r) for b in r[:i]) for r in rows]
    assert np.allclose(m.margins(starts, np.concatenate(rows)), want)


def test_rows_are_scored_by_themselves():
    """Empty rows, ties and any neighbours; also the fit's loop against a plain one."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(60)]
    rows = [(int(i % 3 == 0), toxicity.hashed(" ".join(rng.choice(words, 12)) + (" scum" if i % 3 == 0 else ""))) for i in range(300)]
    model = toxicity.fit(rows)
    score = toxicity.scorer(model)
    texts = [" ".join(rng.choice(words, rng.integers(0, 40))) + (" scum" if i % 4 == 0 else "") for i in range(200)] + ["", None, "scum " * 50_000, "x" * 200_000]
    together = score(texts + texts[::-1])
    assert (together[: len(texts)] == together[len(texts) :][::-1]).all()
    assert all(score([t])[0] == p for t, p in zip(texts, together))
    place = {int(t): i for i, t in enumerate(model.terms)}
    for t, p in zip(texts, together):
        at = [place[h] for h in {zlib.crc32(w.encode()) for w in (t or "").lower().split()} if h in place]
        margin = model.bias + sum(model.weights[i] for i in at) + sum(float(model.vectors[a] @ model.vectors[b]) for k, a in enumerate(at) for b in at[:k])
        assert abs(p - 1 / (1 + np.exp(-np.clip(margin, -30, 30)))) < 1e-9


def test_fit_equals_plain_steps():
    """One step of Adam from the same start, by gradients taken numerically."""
    rng = np.random.default_rng(6)
    rows = [(int(i % 2), toxicity.hashed(" ".join(rng.choice(["a", "b", "c", "d"], 2)) + (" bad" if i % 2 else ""))) for i in range(80)]
    old, toxicity.EPOCHS = toxicity.EPOCHS, 1
    try:
        model = toxicity.fit(rows)
    finally:
        toxicity.EPOCHS = old
    y = np.array([r[0] for r in rows])
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    start = toxicity.Model(0.0, model.terms, np.zeros(model.terms.size), np.random.default_rng(0).normal(0, 0.01, model.vectors.shape))
    at = toxicity.lookup(model.terms, [t for _, t in rows])

    def loss(bias, weights):
        p = toxicity.Model(bias, start.terms, weights, start.vectors).score(*at)
        return -(weight * np.log(np.where(y == 1, p, 1 - p))).sum()

    for k in range(model.terms.size):
        step = np.zeros(model.terms.size)
        step[k] = 1e-5
        slope = (loss(0.0, step) - loss(0.0, -step)) / 2e-5
        if abs(slope) > 1e-6:
            assert np.sign(model.weights[k]) == -np.sign(slope) and abs(abs(model.weights[k]) - 0.15) < 0.01


def test_learns_a_pair_that_no_single_term_shows():
    rng = np.random.default_rng(2)
    rows = []
    for i in range(1200):
        words = {f"w{rng.integers(40)}" for _ in range(8)}
        a, b = rng.random(2) < 0.5
        words |= ({"insult"} if a else set()) | ({"group"} if b else set())
        rows.append((int(a and b), toxicity.hashed(" ".join(words))))
    old = toxicity.EPOCHS
    toxicity.EPOCHS = 300
    try:
        model = toxicity.fit(rows[:900])
    finally:
        toxicity.EPOCHS = old
    starts, index = toxicity.lookup(model.terms, [t for _, t in rows[900:]])
    right = (model.score(starts, index) >= 0.5) == np.array([y for y, _ in rows[900:]])
    assert right.mean() > 0.95


def test_rows_and_odd_cases(spark):
    words = ["alpha", "beta", "gamma", "delta"]
    docs = [(i, f"{words[i % 4]} text {i} " + ("scumbag idiot " * 2 if i % 5 == 0 else ""), "en") for i in range(400)]
    df = spark.createDataFrame([*docs, (500, None, "x"), (501, "", "y"), (None, "idiot scumbag", "z"), (3, docs[3][1], "en")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([*((i, 1, int(i % 5 == 0)) for i in range(400)), (None, 1, 1), (7, None, None), (900, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score(df, toxicity.train(df, labels)).collect()
    assert len(got) == 404 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if r.doc_id is not None and r.doc_id < 400:
            assert r.predicted == int(r.doc_id % 5 == 0)
    kept = toxicity.accepted(df, toxicity.train(df, labels))
    assert kept.columns == df.columns and kept.where("doc_id % 5 = 0 and doc_id < 400").count() == 0 and kept.count() == 404 - 80 - 1
    for bad in (labels.limit(0), labels.where("toxic = 1")):
        assert toxicity.score(df, toxicity.train(df, bad)).count() == 404
    assert toxicity.score(df.limit(0), toxicity.train(df.limit(0), labels)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(docs, toxicity.train(docs, labels)).where("held_out").join(labels, "doc_id").collect()
    wrong = sum(r.predicted != r.toxic for r in rows)
    caught = sum(r.predicted for r in rows if r.toxic) / sum(r.toxic for r in rows)
    assert wrong / len(rows) < 0.04 and caught > 0.8
