"""Order-dependent operators against hand-made and plain versions."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docquarry.functions import numeric, slots, text
from docquarry.operators import chunking, graph, html_tables, state
from docquarry.plans import service
from docquarry.sources import files


@given(st.text(max_size=200))
def test_segments_join_to_the_text(value):
    assert "".join(slots.segment(value)) == value


@settings(max_examples=100)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=20), st.integers(5, 60), st.integers(0, 4))
def test_packed_chunks(sizes, most, overlap):
    body = "".join("字" * (n - 1) + "。" if n > 1 else "。" for n in sizes)
    chunks = chunking.packed(body, most, overlap)
    rebuilt = chunks[0] + "".join(c[overlap:] if len(p) >= overlap else c[len(p) :] for p, c in zip(chunks, chunks[1:]))
    assert rebuilt == body
    assert all(len(c) <= overlap + max(most, *sizes, 0) for c in chunks)


def test_an_overlap_as_large_as_a_chunk_is_refused():
    for most, overlap in ((5, 5), (5, 6), (5, -1)):
        with pytest.raises(ValueError, match="overlap"):
            chunking.packed("a。", most, overlap)


def test_chunks_stop_at_blank_lines_and_keep_long_sentences():
    assert chunking.packed("a。\n\nb。", 300, 80) == ["a。", "b。"]
    assert chunking.packed("", 300, 80) == [] and chunking.packed("字" * 400 + "。", 300, 80) == ["字" * 400 + "。"]
    assert chunking.limits() == (300, 80) and chunking.limits(True) == (450, 120)


HTML = """<table><tr><th rowspan=2>City</th><th colspan=2>Sales</th></tr><tr><th>2023</th><th>2024</th></tr>
<tr><td rowspan=2>A</td><td>1,000</td><td>2</td></tr><tr><td>3</td><td>4</td></tr><tr><td colspan=3>figures are not audited</td></tr></table><p>x</p>
<table><tr><td>k</td><td>v</td></tr><tr><td>a<br>b</td><td></td></tr></table>"""


def test_html_tables(spark):
    cells = list(html_tables.cells_of(HTML))
    assert (0, 0, 1, "Sales 2023", "1,000", False) in cells and (0, 1, 0, "City", "A", False) in cells
    assert [c for c in cells if c[5]] == [(0, 0, 0, "", "figures are not audited", True)]
    assert (1, 0, 0, "k", "a b", False) in cells and (1, 0, 1, "v", "", False) in cells
    rows = html_tables.html_tables(spark.createDataFrame([(1, HTML), (2, None), (3, "<p>")], "page_id long, html string"))
    assert rows.count() == len(cells)


def table(*rows):
    return "<table>" + "".join("<tr>" + "".join(f"<td colspan={c[1]}>{c[0]}</td>" if isinstance(c, tuple) else f"<td>{c}</td>" for c in row) + "</tr>" for row in rows) + "</table>"


def records(html):
    out = {}
    for t, r, _, header, value, note in html_tables.cells_of(html):
        if not note:
            out.setdefault((t, r), {})[header] = value
    return list(out.values())


def test_header_rows_end_at_figures():
    assert records(table("ab", "cd", "12")) == [{"a c": "1", "b d": "2"}]
    assert records(table("a1", "bc", "23", "45")) == [{"a b": "2", "1 c": "3"}, {"a b": "4", "1 c": "5"}]  # a figure in the first row: half of a row must be
    assert records(table("ab", "cd")) == [{"a": "c", "b": "d"}] and records(table("ab")) == []
    assert records(table("ab", ("x", "5 %"), "cd")) == [{"a": "x", "b": "5 %"}, {"a": "c", "b": "d"}]


def test_group_label_constant_column_and_names():
    rows = table(("", "n", "v", "n"), ("g", "1", "k", "2"), ("g", "3", "", "4"), ("5", "k", "6", ""))
    assert records(rows) == [{"n": "1", "v": "k", "n_2": "2"}, {"n": "3", "v": "k", "n_2": "4"}, {"n": "5", "v": "k", "n_2": "6"}]


def test_inner_header_opens_a_second_part():
    html = table(["a", "b", "c", "d"], ["1", "2", "3", "4"], ["a", "b", ("e", 2)], ["", "", "f", "g"], ["5", "6", "7", "8"])
    assert records(html) == [{"a": "1", "b": "2", "c": "3", "d": "4"}, {"a": "5", "b": "6", "f": "7", "g": "8"}]


def test_notes_have_a_label():
    html = table("ab", "12", ["Note", ("all figures are not audited", 2)], [("short", 2)])
    assert [c[3:5] for c in html_tables.cells_of(html) if c[5]] == [("Note", "all figures are not audited")]


def test_packed_rows(spark):
    rng = random.Random(1)
    rows = [("d", "t", i, "x" * rng.randrange(1, 400)) for i in range(60)] + [("d", "u", 0, "y" * 2000), ("d", "u", 1, "z")]
    got = chunking.packed_rows(spark.createDataFrame(rows, "doc_id string, table_id string, row_idx long, text string")).collect()
    for r in got:
        assert r.n <= 15 and (len(r.text) <= 1500 or r.n == 1) and r.last_row - r.first_row + 1 == r.n
    assert sum(r.n for r in got) == 62 and "\n".join(r.text for r in sorted(got, key=lambda r: (r.table_id, r.first_row))) == "\n".join(r[3] for r in rows)


@pytest.mark.parametrize("value,number", [("三十一", 31), ("十二", 12), ("一百零五", 105), ("四十三", 43), ("二千零二十四", 2024), ("三萬五千", 35000), ("12", 12), ("二〇", 20), ("甲", None), ("", None), ("壹佰", 100)])
def test_numerals(value, number):
    assert slots.numeral(value) == number


def test_ratios():
    assert slots.indel_ratio("abc", "abc") == 100 and slots.indel_ratio("abcd", "abxd") == 75 and slots.indel_ratio("", "") == 100
    assert slots.token_set_ratio("a b c", "c b a d") == 100 and slots.token_set_ratio("a b", "x y") < 50


def test_cells_and_questions(spark):
    values = ["1,234", "12%", "3.5億", "1e3", "(5)", "-7", "", "1d", "１２", None, "nan"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = {r.i: r.n for r in df.select("i", numeric.to_number(F.col("v")).alias("n")).collect()}
    assert [got[i] for i in range(len(values))] == [1234, 12, 3.5, 1000, None, -7, None, None, 12, None, None]
    lines = "1. What is it\n- 二\n• Why not?\nnote: skip this\n3. Another question\n4. One more"
    one = spark.createDataFrame([(lines,)], "t string").select(text.parsed_questions(F.col("t"), 3).alias("q")).first().q
    assert one == ["What is it？", "Why not?", "Another question？"]
    pages = spark.createDataFrame([("see page 31, pages 12-15 and 第43-45頁, P.7, page 9-8",)], "t string").select(text.page_numbers(F.col("t")).alias("p")).first().p
    assert pages == [7, 12, 13, 14, 15, 31, 43, 44, 45]


def test_paths_use_no_edge_twice(spark):
    edges = spark.createDataFrame([(1, "a", "b", "REPORTED"), (2, "b", "a", "REPORTED"), (3, "b", "c1", "HAS_CHUNK")], "eid long, src string, dst string, rel string")
    seeds = spark.createDataFrame([("a",)], "id string")
    got = {(r.chunk, r.bonus) for r in graph.expand(edges, seeds, 3, 9).collect()}
    # a-b-a by both edges gives 0.6, and a-b-a-b would need one of them again
    assert got == {("a", 0.6), ("c1", 0.35)}


def test_state(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, name string, n int")
    new = spark.createDataFrame([(2, "B", 20), (3, "c", 30)], "k int, name string, n int")
    once = state.upserted(old, new, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "a", 1), (2, "B", 20), (3, "c", 30)]
    assert sorted(map(tuple, state.upserted(once, new, ["k"]).collect())) == sorted(map(tuple, once.collect()))
    merged = state.merged(old, new, ["k"], ["name", "n"], ["n"])
    assert sorted(map(tuple, merged.collect())) == [(1, "a", 1), (2, "b", 20), (3, "c", 30)]


def test_index_and_ask(spark, tmp_path):
    (tmp_path / "report_one.txt").write_text("Revenue grew in Taipei.\fThe board met in May.")
    (tmp_path / "report_two.txt").write_text("Apples are red fruit.")
    pages = files.extract_pages(files.read_files(spark, f"{tmp_path}/*.txt"), files.plain_pages)
    chunks = service.build_chunks(pages)
    assert sorted((r.doc_id, r.page) for r in chunks.collect()) == [("report_one", 1), ("report_one", 2), ("report_two", 1)]
    points = service.index(chunks).cache()
    requests = [service.Request("when did the board meet in may", 1), service.Request("apples", 1, doc_ids=("report_one",))]
    hits = {r.query_id: (r.doc_id, r.page) for r in service.retrieve(points, requests).collect()}
    assert hits[0] == ("report_one", 2)
    answers = {r.query_id: r.answer for r in service.answer(service.retrieve(points, requests[:1]), requests[:1]).collect()}
    assert "board" in answers[0]
    with pytest.raises(ValueError):
        service.Request("  ")


def test_retrieval_end_to_end(spark):
    """Constraints from the question, relaxation, table evidence, own rerankers and several requests in one plan."""
    rows = [("a.pdf", 1, "paragraph", "cash flow grew in the north"), ("a.pdf", 2, "table_summary", "table of revenue by year"), ("a.pdf", 2, "table_row", "revenue: 10 | year: 2023"), ("a.pdf", 2, "table_row", "costs: 7 | year: 2024"), ("b.pdf", 1, "paragraph", "wind power in the south"), ("b.pdf", 3, "paragraph", "solar power and revenue")]
    chunks = spark.createDataFrame([(f"{d}{p}{i}", d, p, t, x) for i, (d, p, t, x) in enumerate(rows)], "id string, doc_id string, page int, type string, text string")
    points = service.index(chunks)
    known = chunks.select("doc_id")
    requests = [service.Request("solar power", 2), service.Request("revenue table in a.pdf", 5), service.Request("wind", 1, doc_ids=("none.pdf",)), service.Request("what is on page 3", 3)]
    got = {}
    for r in service.retrieve(points, requests, known=known).orderBy("query_id", "final_rank").collect():
        got.setdefault(r.query_id, []).append(r)
    assert got[0][0].text == "solar power and revenue" and len(got[0]) == 2
    assert {r.type for r in got[1]} == {"table_summary", "table_row"} and {r.doc_id for r in got[1]} == {"a.pdf"} and len(got[1]) == 3
    assert got[2][0].text == "wind power in the south"
    assert {(r.doc_id, r.page) for r in got[3]} == {("b.pdf", 3)}
    for engine in ("vector", "keyword"):
        assert service.retrieve(points, requests[:1], engine).first().text == "solar power and revenue"
    slots.register("rerank", lambda queries, texts: [-float(len(t)) for t in texts])
    try:
        texts = [r.text for r in service.retrieve(points, requests[:1]).orderBy("final_rank").collect()]
    finally:
        slots._SLOTS.pop("rerank")
    assert texts == sorted(texts, key=len)


def test_fuzzy_ids_of_questions(spark):
    from docquarry.operators import evidence

    known = spark.createDataFrame([(f"report{i:03d}x",) for i in range(60)], "doc_id string")
    queries = spark.createDataFrame([(1, "see report017y please"), (2, "report005x"), (3, "nothing alike")], "query_id long, query string")
    assert {tuple(r) for r in evidence.named_documents(queries, known).collect()} == {(1, "report017x"), (2, "report005x")}


def test_marked_pairs_and_file_numbers(spark):
    body = "Q: what is the revenue? A: it was ten million dollars\nQ: short A: too short question\n問題：今年的營收是多少？ 回答：營收約為一千萬元，比去年成長。"
    df = spark.createDataFrame([(body, "scan_p012_table3.html"), ("", "scan-7.txt"), (None, "plain.pdf")], "t string, n string")
    rows = df.select(text.qa_pairs(F.col("t")).alias("q"), text.page_of_file(F.col("n")).alias("p"), text.table_of_file(F.col("n")).alias("k")).collect()
    assert [(x.question, x.answer) for x in rows[0].q] == [("what is the revenue?", "it was ten million dollars"), ("今年的營收是多少？", "營收約為一千萬元，比去年成長。")]
    assert [(r.p, r.k) for r in rows] == [(12, 3), (7, None), (None, None)]
    cleaned = spark.createDataFrame([("Tables on page 3-4 and 第五頁，表2 costs",)], "t string").select(text.clean_query(F.col("t")).alias("c")).first().c
    assert cleaned == "on and costs"
