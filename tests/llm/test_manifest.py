import hashlib
import zlib
from collections import defaultdict

import pytest

from docquarry.llm import manifest


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def row_digest(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def up(nodes):
    return [H("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]


def climbed(leaves):
    """Levels from the leaves to the one node left."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append(up(levels[-1]))
    return levels


def siblings(levels, at):
    """(before, after) of the node above the leaf on each level."""
    out = []
    for nodes in levels[:-1]:
        run = nodes[at // 8 * 8 : at // 8 * 8 + 8]
        out.append(("".join(run[: at % 8]), "".join(run[at % 8 + 1 :])))
        at //= 8
    return out


def brute_force(rows):
    trees = defaultdict(list)
    for row in rows:
        trees["0" if row[2] is None else "1" + row[2]].append((row[0] is not None, row[0] or 0, row_digest(row), row))
    trees = {k: sorted(v, key=lambda x: (x[:3], repr(x[3]))) for k, v in trees.items()}
    names = sorted(trees, key=lambda k: k.encode())
    levels = {k: climbed([x[2] for x in v]) for k, v in trees.items()}
    top = climbed([levels[k][-1][0] for k in names])
    out = []
    for k in names:
        for i, (_, _, leaf, row) in enumerate(trees[k]):
            path = siblings(levels[k], i) + siblings(top, names.index(k))
            found = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                found = row_digest(row[:4] + ("".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]),))
            for before, after in path:
                found = H(before + found + after)
            root = top[-1][0]
            out.append((row[0], leaf, levels[k][-1][0], root, H("".join(b + a for b, a in path)), found, found == root))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, POS long"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "other", 1) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in manifest.verify(df).collect()), key=repr)


def test_paths_leaf_by_leaf():
    for n in (1, 2, 7, 8, 9, 63, 64, 65, 200, 511, 512):
        leaves = [H(str(i)) for i in range(n)]
        levels = climbed(leaves)
        height = manifest.height_of(n)
        assert height == len(levels) - 1 and manifest.root_of(leaves, height) == levels[-1][0]
        for i, path in enumerate(manifest.paths_of(leaves, height)):
            assert path == siblings(levels, i)
            assert manifest.fold(leaves[i], path) == levels[-1][0]


def test_a_treehash_holds_a_run_a_level():
    stack = manifest.Treehash(3)
    for i in range(4000):
        stack.take(str(i))
        assert all(len(run) < 8 for run in stack.runs[:-1])


@pytest.mark.parametrize("n", [1, 9, 700])
def test_equals_brute_force(spark, n):
    rows = [(i, "src", ["en", "fr", "日"][i % 3] if n > 9 else "en", i, f"Some Text {i}") for i in range(n)]
    rows += [(None, None, None, None, None), (None, None, None, None, None), (5000, "s", "", 0, ""), (5000, "s", "", 0, ""), (5000, "s", "", 0, "Twin"), (5001, "", None, 2, "É" * 30_000 + "A:b-")]
    assert run(spark, rows) == brute_force(rows)


def test_one_language_over_many_blocks(spark):
    rows = [(i, "src", "en", i, f"Text {i}") for i in range(2 * manifest.BLOCK * 8 + 5)] + [(10**6, "x", "de", 1, "Alone")]
    got, want = run(spark, rows), brute_force(rows)
    assert got == want
    assert {r[-1] for r in got} == {True, False}


def test_an_empty_table(spark):
    assert run(spark, []) == []


def test_paths_fold_to_the_root(spark):
    df = spark.createDataFrame([(i, "a", f"l{i % 11}", 1, "x") for i in range(300)], "doc_id long, source string, lang string, n_chars long, text string")
    for r in manifest.manifest(df).collect():
        assert r.verified and manifest.fold(r.leaf, [(p.before, p.after) for p in r.path]) == r.root
