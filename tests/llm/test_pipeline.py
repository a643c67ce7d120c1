import os
from collections import Counter

import pytest

import corpus_pipeline
from docquarry.llm import quality, toxicity
from tests.llm.test_near_dups import brute_force

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_stages_against_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, [tuple(r) for r in docs.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        rows = [tuple(r) for r in after.collect()]
        texts = [r[columns.index("text")] for r in before]
        if name == "quality_rules":
            refs = {r.lang: r.ref for r in quality.references(docs).collect()}
            verdict, at = quality.judged_by(), columns.index("lang")
            want = [r for r, t in zip(before, texts) if verdict(t, refs.get(r[at] or ""))["kept"]]
        elif name == "toxicity":
            scores = toxicity.scorer(toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet")))(texts)
            want = [r for r, s in zip(before, scores) if s < toxicity.THRESHOLD]
        elif name == "near_dedup":
            ids = {d for d, _, c in brute_force([(r[0], t) for r, t in zip(before, texts)], 5) if d == c}
            want = [r for r in before if r[0] in ids]
        else:
            assert {r.doc_id for r in after.collect()} == {r[0] for r in before}
            break
        assert after.columns == columns and Counter(rows) == Counter(want) and len(rows) < len(before)
        docs, before = after, rows
    assert corpus_pipeline.run(spark, SF).count() == len(rows)


def test_repeated_and_null_rows(spark):
    words = " ".join(f"word{i}" for i in range(40))
    df = spark.createDataFrame([(1, words, "en"), (1, words, "en"), (2, words + " x", "en"), (None, words, "en"), (None, None, None), (4, None, "en"), (5, "", "en")], "doc_id long, text string, lang string")
    kept = corpus_pipeline.near_dedup(spark, df, "")
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, -1, 1, 4, 5]
    assert corpus_pipeline.near_dedup(spark, df.limit(0), "").count() == 0


def test_stages_with_odd_rows_and_columns(spark, tmp_path):
    """Null and clashing columns, maps, dotted names, long texts, ties and no rows pass every stage."""
    words = " ".join(f"word{i} and the other{i % 7}" for i in range(60))
    rows = [(i, f"{words} end{i % 3}", "en", {"k": i}, 0.5, "r") for i in range(20)] + [(None, words, None, None, None, None), (40, None, "en", None, None, None), (41, "", "xx", {}, 0.0, ""), (42, words * 300, "en", {"a": 1}, 1.0, "z"), (3, f"{words} end0", "en", {"k": 3}, 0.5, "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, `a.b` map<string,long>, score double, __ref string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(20)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (df, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == df.columns and out.count() <= docs.count()
        assert (stage := corpus_pipeline.STAGES[-1][1])(spark, docs, str(tmp_path)).count() >= docs.count()
    kept = corpus_pipeline.near_dedup(spark, df, "")
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == [-1, 0, 40, 41]  # the long text repeats the same shingles
