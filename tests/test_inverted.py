"""A stored index against one made anew from the texts that are there."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from docquarry.operators import inverted, search
from docquarry.operators.inverted import InvertedIndex
from docquarry.sources.upserts import Folder, UpsertTable


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def made_anew(held):
    counted = {i: Counter(words(t)) for i, t in held.items()}
    postings = sorted((i, w, n, sum(c.values())) for i, c in counted.items() for w, n in c.items())
    df = Counter(w for c in counted.values() for w in c)
    return postings, sorted(df.items()), (len(held), sum(sum(c.values()) for c in counted.values()))


def state(index):
    postings = sorted((r.id, r.token, r.tf, r.dl) for r in index.postings.read().collect())
    total = index.totals.read().first()
    return postings, sorted((r.token, r.df) for r in index.vocabulary.read().collect()), (total.n, total.dl)


def frame(spark, held):
    return spark.createDataFrame(list(held), "id long, text string")


def test_adds_changes_and_removals(spark, tmp_path):
    rnd, held = random.Random(2), {}
    index = InvertedIndex(spark, str(tmp_path / "i"), buckets=3)
    for step in range(4):
        new = {rnd.randrange(20): " ".join(rnd.choice("red green blue Blue tan grey".split()) for _ in range(rnd.randrange(6))) for _ in range(8)}
        if step == 1:
            new |= {50: None, 51: "", 52: "common " * 3000}
        gone = [g for g in (rnd.randrange(20) for _ in range(4)) if g not in new] if step else []
        index.add(frame(spark, new.items()), spark.createDataFrame([(g,) for g in gone], "id long") if gone else None)
        held |= new
        for g in gone:
            held.pop(g, None)
        assert state(index) == made_anew(held)
    asked = spark.createDataFrame([(1, "blue red common"), (2, "tan"), (3, "nowhere"), (4, "")], "query_id long, query string")
    terms = search.query_terms(asked)
    docs = frame(spark, held.items())
    plain = search.top_of(search.bm25_scores(search.postings(docs, terms), terms, search.corpus_stats(docs)), 5)
    assert sorted(map(tuple, index.bm25(terms, 5).collect())) == sorted(map(tuple, plain.collect()))
    assert sorted(map(tuple, index.keyword(terms, 9).collect())) == sorted(map(tuple, search.keyword_topk(search.postings(docs, terms), terms, 9).collect()))


def test_a_question_reads_its_buckets_only(spark, tmp_path):
    index = InvertedIndex(spark, str(tmp_path / "i"), buckets=16)
    index.add(frame(spark, [(i, f"word{i} shared") for i in range(200)]))
    terms = search.query_terms(spark.createDataFrame([(1, "word7 shared")], "query_id long, query string"))
    read = {re.search(r"__bucket=(\d+)", f)[1] for f in index.wanted(terms).inputFiles()}
    assert len(read) == len(index.postings.buckets_of(terms.select("token"))) <= 2


def test_repeated_ids_null_ids_and_an_empty_table(spark, tmp_path):
    index = InvertedIndex(spark, str(tmp_path / "i"), buckets=2)
    index.add(frame(spark, []))
    assert state(index) == ([], [], (0, 0))
    index.add(frame(spark, [(1, "a b"), (1, "c"), (None, "d"), (2, "c c")]))
    assert state(index) == made_anew({1: "c", 2: "c c"})


@pytest.mark.parametrize("lost", ["vocabulary", "totals"])
def test_a_lost_batch_is_repeated(spark, tmp_path, monkeypatch, lost):
    index = InvertedIndex(spark, str(tmp_path / "i"), buckets=2)
    index.add(frame(spark, [(1, "a b"), (2, "b c")]), batch=0)
    put = Folder.put
    monkeypatch.setattr(Folder, "put", lambda self, *a: (_ for _ in ()).throw(OSError("lost")) if self.path.endswith(lost) else put(self, *a))
    with pytest.raises(OSError):
        index.add(frame(spark, [(2, "a a"), (3, "c")]), batch=1)
    monkeypatch.undo()
    for _ in range(2):
        index.add(frame(spark, [(2, "a a"), (3, "c")]), batch=1)
        assert state(index) == made_anew({1: "a b", 2: "a a", 3: "c"})
    assert UpsertTable(spark, str(tmp_path / "i" / "totals"), ["name"]).manifest().writers["add"] == 1


def test_tokens_are_counted_where_a_text_lies(spark, tmp_path):
    held = {1: "b a B", 2: None, 3: "", 4: "é é 你好"}
    own = InvertedIndex(spark, str(tmp_path / "i"))._words(frame(spark, held.items()))
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange") == 1
    assert {r.id: (r.dl, r.counted) for r in own.collect()} == {i: (len(words(t)), dict(Counter(words(t)))) for i, t in held.items()}


def test_disk_holds_one_version_in_few_bytes_a_posting(spark, tmp_path):
    rnd, held = random.Random(3), {}
    index = InvertedIndex(spark, str(tmp_path / "i"), buckets=2)
    for step in range(3):
        new = {i: " ".join(f"w{int(rnd.paretovariate(0.7)) % 3000}" for _ in range(200)) for i in range(step * 300, step * 300 + 500)}
        index.add(frame(spark, new.items()), spark.createDataFrame([(step,)], "id long"))
        held |= new
        if step:
            held.pop(step, None)
    assert state(index) == made_anew(held)  # the first batch has the id that it takes out, so it stays
    tables = [index.postings, index.documents, index.vocabulary, index.totals]
    assert all(len(t.versions()) == 1 for t in tables) and not (tmp_path / "i" / "staging").exists()
    named = {f for t in tables for entries in t.manifest().sets.values() for f, _, _ in entries}
    there = {f"data/{n}/{b}" for t in tables for n in t.folder.names("data") for b in t.folder.names(f"data/{n}") if b.startswith("__bucket")}
    assert there <= named
    stored = sum(f.stat().st_size for f in (tmp_path / "i" / "postings" / "data").rglob("*.parquet"))
    assert stored < 8 * index.postings.read().count()


def test_postings_of_questions_move_once_as_blocks(spark, tmp_path):
    index = InvertedIndex(spark, str(tmp_path / "i"), buckets=2)
    index.add(frame(spark, [(i, f"w{i % 3} shared") for i in range(-20, 20)]))
    terms = search.query_terms(spark.createDataFrame([(q, "w1 shared") for q in range(30)], "query_id long, query string"))
    found = index.bm25(terms, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" in plan and "hashpartitioning(slice" in plan
    assert "hashpartitioning(query_id, id" not in re.sub(r"#\d+L?", "", plan)
    assert sorted((r.query_id, r.id) for r in found.collect()) == [(q, i) for q in range(30) for i in (-20, -17)]


def test_blocks_hold_any_id(spark):
    ids = np.array([-(2**63), -1, 0, 2**63 - 1, -5, 7, 7 + 2**40], np.int64)
    group, marked, dl = np.array([0, 0, 0, 0, 1, 2, 2]), np.array([2, 1, 300, 2**33, 4, 6, 2]), np.array([1, 0, 2**31, 5, 127, 128, 2**14])
    first, blocks = inverted._packed(group, ids, marked, dl)
    assert first.tolist() == [0, 4, 5]
    assert [x.tolist() for x in inverted._unpacked(blocks)] == [group.tolist(), ids.tolist(), marked.tolist(), dl.tolist()]
    assert [x.tolist() for x in inverted._unpacked(blocks[1:])] == [[0, 1, 1], ids[4:].tolist(), marked[4:].tolist(), dl[4:].tolist()]
