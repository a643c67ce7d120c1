"""Ids that questions name, against every question held against every id."""

import itertools
import random

import pytest

from docquarry.functions import slots
from docquarry.operators import evidence, naming


def brute_force(queries, known):
    ids = sorted({d for d in known if d})
    out = set()
    for q, text in queries:
        found = [d for d in ids if d.lower() in (text or "").lower()]
        if not found:
            for word in slots.segment(text or ""):
                if len(word) >= 5 and word.lower() not in evidence.COMMON:
                    ratio, best = min(((-slots.indel_ratio(word, d), d) for d in ids), default=(0, ""))
                    found += [best] if -ratio > 80 else []
        out |= {(q, d) for d in found}
    return out


@pytest.mark.parametrize("shortest", [1, 6])
def test_equals_brute_force(spark, shortest):
    rnd = random.Random(6)
    known = ["".join(rnd.choice("abcAB12") for _ in range(rnd.randrange(shortest, 14))) for _ in range(150)] + ["年報2024", "abcd", "report", "Report", "", None, "x" * 60, "a b c d e", "aaaaaaaa"]
    known = [d for d in known if not d or len(d) >= shortest]

    def changed(d):
        k = rnd.randrange(len(d) + 1)
        return rnd.choice([d[:k] + "z" + d[k:], d[:k] + d[k + 1 :], d[:k] + "q" + d[k + 1 :], d, d[::-1]])

    words = [changed(changed(rnd.choice(known[:-4]))) for _ in range(500)]
    queries = [(k, f"show {w} now") for k, w in enumerate(words)]
    queries += [(900, None), (901, ""), (902, "complete"), (903, "x" * 50), (904, "y" * 5000), (905, "看年報2024頁"), (906, "reporx reqort aaaaaaa"), (907, "REPORT"), (908, "the A B C D E f")]
    got = {tuple(r) for r in evidence.named_documents(spark.createDataFrame(queries, "query_id long, query string"), spark.createDataFrame([(d,) for d in known], "doc_id string")).collect()}
    want = brute_force(queries, known)
    assert got == want
    exact = {q for q, d in want if d.lower() in dict(queries)[q].lower()}
    assert len(exact) > 50 and (shortest == 1 or len({q for q, _ in want} - exact) > 50)


def test_nothing_known_or_asked(spark):
    asked = spark.createDataFrame([(1, "report")], "query_id long, query string")
    known = spark.createDataFrame([("report",)], "doc_id string")
    assert evidence.named_documents(asked, known.limit(0)).count() == 0 and evidence.named_documents(asked.limit(0), known).count() == 0


def test_ids_alike_meet_few_words(spark, monkeypatch):
    """Numbered ids all share their pairs of letters; a word with a letter wrong meets only those it could be."""
    known = [f"Supplier{i:09d}" for i in range(400)]
    words = [f"Suqplier{i:09d}" for i in range(0, 400, 2)] + ["Supplier00000007", "Supplier0000000123", "Supplier0000000xx45", "Suppler00000012", "upplier000000099x", "Sapplyer000000031"]
    ids, own = spark.createDataFrame([(d,) for d in known], "doc_id string"), spark.createDataFrame([(w,) for w in words], "word string")
    want = {w: min((-slots.indel_ratio(w, d), d) for d in known)[1] for w in words}
    assert dict(map(tuple, naming.most_like(own, ids).collect())) == want
    monkeypatch.setattr(naming, "FEW_LETTERS", 0)  # the way of words that differ more gives the same
    assert dict(map(tuple, naming.most_like(own.limit(20), ids).collect())) == {w: want[w] for w in words[:20]}
    monkeypatch.undo()
    assert naming._close(own, ids).count() < 20 * len(words)


def test_close_ids_are_those_of_few_letters(spark):
    """All texts over two letters: pairs that lack a letter each at most, or two letters of the id."""
    texts = ["".join(x) for n in range(1, 6) for x in itertools.product("ab", repeat=n)]
    frame = lambda name: spark.createDataFrame([(t,) for t in texts], f"{name} string")
    less = {t: {t[:i] + t[i + 1 :] for i in range(len(t))} for t in [*texts, ""]}
    want = {(w, d) for w in texts for d in texts if ({w} | less[w]) & ({d} | less[d]) or w in {y for x in less[d] for y in less[x]}}
    assert {tuple(r) for r in naming._close(frame("word"), frame("doc_id")).collect()} == want
