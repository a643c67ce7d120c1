import math
import random

import numpy as np
import pytest

from docquarry.llm import negatives


def brute_force(rows):
    usable = {}
    for vec_id, vec, label in rows:
        if vec_id is None or label is None or vec is None or any(x is None or not math.isfinite(x) or abs(x * 256) >= negatives.LARGEST for x in vec):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        own = (label, [math.floor(256 * float(np.float32(x))) for x in vec])
        usable[vec_id] = min(usable.get(vec_id, own), own)
    out = []
    for a, (label, vec) in usable.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(vec, v)), i, own) for i, (own, v) in usable.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            within = [(-n, i) for n, i, own in scored if own != label and -80 * s <= -100 * n <= -100 * s][:5]
            out += [(a, p, k + 1, i, -s, n) for k, (n, i) in enumerate(within)]
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(i, v, l, 1, "x") for i, v, l in rows], "vec_id long, embedding array<float>, label int, score int, block string")
    return sorted(tuple(r) for r in negatives.mine(df).collect())


def vectors(n, dims, rnd, step=100, spread=1.0):
    return [(i * step // 20, [rnd.gauss(0, spread) for _ in range(dims)], rnd.randrange(4)) for i in range(n)]


@pytest.mark.parametrize("dims, spread", [(3, 1.0), (16, 0.2), (8, 3000.0)])
def test_equals_brute_force(spark, dims, spread):
    rows = vectors(400, dims, random.Random(dims), spread=spread)
    assert run(spark, rows) == brute_force(rows)


def test_odd_rows_ties_and_copies(spark):
    rnd = random.Random(3)
    rows = vectors(300, 4, rnd)
    rows += [(20_000 + i, [0.5, 0.5, 0.5, 0.5], i % 3) for i in range(400)]  # one common vector
    rows += [(100, None, 1), (None, [1.0] * 4, 1), (200, [1.0, None, 0.0, 0.0], 1), (300, [1.0] * 4, None), (30_001, [math.nan] * 4, 1), (30_002, [math.inf, 0.0, 0.0, 0.0], 1), (30_003, [1e30, 0.0, 0.0, 0.0], 1)]
    rows += [(30_100, [], 1), (30_200, [1.0], 1), (30_300, [1.0] * 9, 2), (400, [2.0] * 4, 1), (400, [2.0] * 4, 1), (400, [1.0] * 4, 3), (-700, [1.0] * 4, -3)]
    got = run(spark, rows)
    assert got == brute_force(rows) and len(got) > 100


def test_few_or_no_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(100, [1.0], 1)]) == []
    rows = [(100, [1.0, 1.0], 1), (101, [1.0, 1.0], 1), (102, [1.0, 0.9], 2)]
    assert run(spark, rows) == brute_force(rows) and len(run(spark, rows)) == 1


def test_many_blocks_and_groups(spark, monkeypatch):
    for name, value in (("ANCHORS", 3), ("GROUP_LEAST", 40), ("GROUP_MOST", 40), ("ROWS_EACH", 16), ("ANCHORS_EACH", 2)):
        monkeypatch.setattr(negatives, name, value)
    rows = vectors(600, 5, random.Random(9))
    assert run(spark, rows) == brute_force(rows)


def test_bounds_hold_the_score():
    rng = np.random.default_rng(5)
    vectors, anchors = rng.integers(-900, 900, (500, 12)), rng.integers(-900, 900, (40, 12))
    page = negatives.Approximation(vectors)
    tables, slack = page.tables(anchors)
    most, exact = page.most(tables, 0, 500), vectors @ anchors.T
    assert (exact <= most).all() and (exact >= most - slack).all()
