"""Fuzzy echoes of lines against a plain version with the full table of common subsequences."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docquarry.functions import slots, subsequences
from docquarry.operators import echoes, evidence
from docquarry.plans import catalog


def plain_ratio(a, b):
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


def plain_set_ratio(a, b):
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    left, right = (" ".join(filter(None, [both, " ".join(sorted(s - (x & y)))])) for s in (x, y))
    if both and (not x - y or not y - x):
        return 100.0
    return max(plain_ratio(*p) for p in [(left, right)] + ([(both, left), (both, right)] if both else []))


@settings(max_examples=300, deadline=None)
@given(st.text("ab字 ", max_size=90), st.text("ab字 ", max_size=90))
def test_ratios(a, b):
    assert slots.indel_ratio(a, b) == plain_ratio(a, b) and slots.token_set_ratio(a, b) == plain_set_ratio(a, b)
    x, y = set(a.split()), set(b.split())
    assert all(slots.token_sets_alike(x, y, (len(" ".join(x)), len(" ".join(y))), k) == (plain_set_ratio(a, b) >= k) for k in (30, 60, 85, 100))


def test_whole_lines_against_brute_force(spark, tmp_path):
    start = "one opening of forty characters or more, " * 2
    texts = [
        "\n".join([start + "apples ripen slowly under bright summer skies every single year", start + "quartz pump fjord vexing dwarves jolt my bizarre glyph nymph box", "another line", "", "another line", "another lime"]),
        "\n".join(["zulu yankee xray whiskey victor uniform tango " + "tail of the line that both share in full " * 3, "alpha", "mike lima kilo " + "tail of the line that both share in full " * 3]),
        "another line",
    ]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.pos, r.text) for r in catalog.queries()["fuzzy_dedup"](spark, str(tmp_path)).collect()}
    lines = [(str(i), k, t) for i, text in enumerate(texts) for k, t in enumerate(text.split("\n"), 1) if t.strip()]
    want = {x for x in lines if not any(y[0] == x[0] and y[1] < x[1] and plain_set_ratio(x[2], y[2]) >= 85 for y in lines)}
    assert got == want and len(texts) < len(want) < len(lines)


def near(words, rnd):
    """A line with a few of its letters changed, or a word more or fewer."""
    out = list(words)
    for _ in range(rnd.randrange(1, 4)):
        k = rnd.randrange(len(out))
        kind = rnd.randrange(4)
        if kind == 0:
            out[k] = out[k][:-1] + "q"
        elif kind == 1:
            out.insert(k, "more")
        elif kind == 2 and len(out) > 1:
            del out[k]
        else:
            rnd.shuffle(out)
    return " ".join(out)


def test_bounds_never_lose_a_pair():
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdeé字") for _ in range(rnd.randrange(1, 12))) for _ in range(60)]
    texts = [[rnd.choice(words) for _ in range(rnd.randrange(1, 14))] for _ in range(120)]
    texts = [" ".join(t) for t in texts] + [near(t, rnd) for t in texts] + ["", " ", "a", "ab", "x" * 4000, "x" * 3000 + "y" * 500]
    lines = echoes.Lines()
    for t in texts:
        lines.number(t)
    lines.count()
    own = list(lines.at)
    i, j = (x.ravel() for x in np.indices((len(own), len(own))))
    may = lines.may_be_alike(i, j, 85)
    alike = np.array([plain_set_ratio(own[a], own[b]) >= 85 for a, b in zip(i, j)])
    assert not (alike & ~may).any() and may.sum() < 0.2 * len(may)
    assert (lines.alike(i, j, 85) == alike).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ab字 é", max_size=150), st.text("abc字", max_size=150)), max_size=8))
def test_common_lengths(pairs):
    assert subsequences.common_lengths(pairs).tolist() == [round(plain_ratio(a, b) * (len(a) + len(b)) / 200) for a, b in pairs]


@pytest.mark.parametrize("placed, block", [(True, 2_000), (False, 2_000), (True, 7)])
def test_sentences_against_rows_by_brute_force(spark, monkeypatch, placed, block):
    for name, value in (("BLOCK", block), ("LINES", 30), ("PAIRS", 64), ("EXACT", 20)):
        monkeypatch.setattr(echoes, name, value)
    rnd = random.Random(block)
    words = ["".join(rnd.choice("abcdefg") for _ in range(rnd.randrange(2, 9))) for _ in range(40)]
    base = [[rnd.choice(words) for _ in range(rnd.randrange(2, 9))] for _ in range(30)]
    sentences = [(rnd.choice(["d", "e", None]), rnd.choice([1, 2, None]), k, rnd.choice([" ".join(rnd.choice(base)), near(rnd.choice(base), rnd)])) for k in range(150)] + [("d", 1, 200, None), ("d", 1, 201, ""), ("d", 1, 202, " ")]
    rows = [(rnd.choice(["d", "e", None]), rnd.choice([1, 2, None]), rnd.randrange(150), rnd.choice([" ".join(rnd.choice(base)), near(rnd.choice(base), rnd)])) for k in range(80)] + [("d", 1, 3, None), ("d", 1, 4, ""), ("d", 1, 5, "  ")]
    left = spark.createDataFrame(sentences, "doc_id string, page int, pos int, text string")
    right = spark.createDataFrame(rows, "doc_id string, page int, pos int, text string")
    got = sorted(map(tuple, evidence.without_table_echoes(left, right if placed else right.drop("pos")).collect()), key=repr)
    echo = lambda s, r: s[:2] == r[:2] and s[3] is not None and r[3] and (not placed or r[2] < s[2]) and plain_set_ratio(s[3], r[3]) >= 85
    want = sorted((s for s in sentences if not any(echo(s, r) for r in rows)), key=repr)
    assert got == want and 5 < len(want) < 150
    assert evidence.without_table_echoes(left.limit(0), right).count() == 0 and evidence.without_table_echoes(left, right.limit(0)).count() == len(sentences)
