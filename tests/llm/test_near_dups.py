import os
import random

import numpy as np
import pytest

from docquarry.llm import near_dups

SF = "/root/testdata/sf0.01"


def brute_force(rows, k):
    """(doc_id, n_shingles, component) of rows of (doc_id, text) by comparing all pairs."""
    def shingles(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        near = np.bincount(np.concatenate([where[x] for x in s]), minlength=len(rows)) if s else np.zeros(len(rows))
        for j in np.flatnonzero(near[:i]):
            if 100 * near[j] >= 80 * (len(s) + len(sets[j]) - near[j]):
                parent[find(i)] = find(int(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def run(spark, rows, k):
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, component_id string, bands string")
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dups.near_duplicates(df, k).collect())


def test_chains_stars_copies_and_blanks(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, n = [], 0
    for size in (1, 3, 12, 40, 300):
        base = [word() for _ in range(size)]
        chain = list(base)
        for copy in range(24):
            edited = list(base)
            for _ in range(max(1, size // 22)):
                edited[rng.randrange(size)] = word()
            chain[copy * size // 24 % size] = word()
            for text in (" ".join(edited), " ".join(chain), " ".join(base).upper() if copy % 5 == 0 else "\t".join(base)):
                rows.append((n * 7 % 1009, text))
                n += 1
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "one"), (2004, "One"), (2005, "one two")]
    for k in (2, 5):
        assert run(spark, rows, k) == brute_force(rows, k)


def test_null_ids_repeated_rows_and_no_rows(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(None, text), (5, text), (5, text), (7, text), (5, "quite another text"), (3, "quite another text")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dups.near_duplicates(df, 2).collect()}
    assert got == {(None, None, True), (5, 3, False), (7, 3, False), (3, 3, True)}
    assert near_dups.near_duplicates(df.limit(0), 2).count() == 0


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    for n in (1, 2, 30, 500):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        assert (near_dups.sketch(a) != near_dups._NONE).all()
    a = rng.integers(0, 2**63, 900).astype(np.uint64)
    found = [(near_dups.sketch(a[i : i + 600], 512) == near_dups.sketch(a[i + 66 : i + 666], 512)).mean() for i in range(0, 234, 13)]
    assert abs(np.mean(found) - 534 / 666) < 0.02


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("k", [2, 5])
def test_whole_table(spark, k):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dups.near_duplicates(docs, k).collect())
    assert got == brute_force(rows, k)
