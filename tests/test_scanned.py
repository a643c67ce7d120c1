"""Lists by one scan of the texts against those by joins of postings."""

import random

from docquarry.operators import graph, search


def lists(spark, held, asked, k, keywords):
    docs = spark.createDataFrame(held, "id long, text string").repartition(3)
    terms = search.query_terms(spark.createDataFrame(asked, "query_id long, query string"))
    stats, index = search.corpus_stats(docs), search.postings(docs, terms)
    got = sorted(map(tuple, search.scanned(docs, terms, stats, k, keywords).select("list", "query_id", "id", "score", "rank").collect()))
    bm25 = [("bm25", *r) for r in search.top_of(search.bm25_scores(index, terms, stats), k).collect()]
    return got, sorted(bm25 + [("keyword", *r) for r in search.keyword_topk(index, terms, keywords).collect()])


def test_equals_joins(spark, monkeypatch):
    rnd = random.Random(4)
    some = lambda n: " ".join(rnd.choice("ab cd ef gh ij kl mn é 你好 Op".split()) for _ in range(n))
    held = [(i - 40, some(rnd.randrange(12))) for i in range(300)] + [(900, None), (901, ""), (902, "common " * 3000), (903, "ab AB ab")]
    asked = [(q, some(1 + q % 4)) for q in range(30)] + [(50, "common nowhere"), (51, "nowhere"), (52, ""), (53, None), (54, "ab")]
    monkeypatch.setattr(search, "SCAN_TEXTS", 7)
    for terms in (500_000, 10):  # one block, and several
        monkeypatch.setattr(search, "SCAN_TERMS", terms)
        got, want = lists(spark, held, asked, 4, 3)
        assert got == want and {r[0] for r in got} == {"bm25", "keyword"}


def test_nothing_asked_or_held(spark):
    assert lists(spark, [(1, "ab")], [], 4, 3) == ([], [])
    assert lists(spark, [], [(1, "ab")], 4, 3) == ([], [])


def test_no_postings_are_shuffled(spark):
    docs = spark.createDataFrame([(1, "ab cd")], "id long, text string")
    terms = search.query_terms(spark.createDataFrame([(1, "ab")], "query_id long, query string"))
    plan = search.scanned(docs, terms, search.corpus_stats(docs), 4)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "Explode" not in plan and plan.count("Exchange") == 1


def test_first_chunks_of_documents(spark):
    """All chunks two edges from the hits, against those that come out of each document's first ones."""
    rnd = random.Random(1)
    links = [(rnd.choice("xyz"), f"c{rnd.randrange(60)}") for _ in range(150)]
    hits = [(q, rnd.randrange(60)) for q in range(8) for _ in range(3)]
    edges = spark.createDataFrame([(n, s, d, "HAS_CHUNK") for n, (s, d) in enumerate(links)], "eid long, src string, dst string, rel string")
    got = graph.evidence(edges, spark.createDataFrame(hits, "query_id long, id long"), 3, lambda d: d)
    want = []
    for q in range(8):
        seeds = {f"c{i}" for p, i in hits if p == q}
        found = set()
        for doc in "xyz":
            own = {d for s, d in links if s == doc}
            at = own & seeds
            found |= own - at if len(at) == 1 else own if at else set()
        want += [(q, int(c[1:]), n) for n, c in enumerate(sorted(found)[:3], 1)]
    assert sorted((r.query_id, r.id, r.rank) for r in got.collect()) == sorted(want)
