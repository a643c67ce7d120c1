"""Question-answer pairs and the command line over a small collection."""

import io
import json

from docquarry import cli
from docquarry.operators import generation
from docquarry.plans import service


def test_pairs_keep_to_their_document(spark):
    pages = spark.createDataFrame([("a", 1, "Solar power grew in May. Wind power fell."), ("a", 2, " "), ("b", 1, "Solar power grew in June."), ("b", None, "x")], "doc_id string, page int, text string")
    points = service.index(service.build_chunks(pages)).cache()
    asked = spark.createDataFrame([("q1", "a", "solar power grew"), ("q2", "b", "zebra"), ("q3", "none", "solar")], "query_id string, doc_id string, query string")
    rows = {r.id: r for r in generation.qa_pairs(asked, points).collect()}
    assert set(rows) == {"q1", "q2", "q3"}
    assert [(s.source_index, s.doc_id, s.page) for s in rows["q1"].sources] == [(1, "a", "1")] and "May" in rows["q1"].answer
    assert rows["q2"].sources == rows["q3"].sources == [] and rows["q2"].answer == rows["q3"].answer == generation.NO_ANSWER
    assert {r.doc_id for r in service.qa_pairs(points).collect()} == {"a", "b"}
    assert generation.qa_pairs(asked.limit(0), points).count() == 0


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "one.txt").write_text("Solar power grew in May.\fWind power fell.")
    pattern, collection, out = str(tmp_path / "*.txt"), str(tmp_path / "points"), str(tmp_path / "out")
    cli.main(["index", pattern, collection])
    cli.main(["debug-extract", pattern, out])
    assert spark.read.json(f"{out}/pages").count() == 2 and spark.read.json(f"{out}/nodes").count() == 2
    cli.main(["qa-generate", collection, "one", f"{out}/qa", "-n", "2"])
    pairs = [json.loads(line) for f in (tmp_path / "out" / "qa").glob("*.json") for line in f.read_text().splitlines()]
    assert pairs and all(p["id"] and p["doc_id"] == "one" for p in pairs)
    monkeypatch.setattr("sys.stdin", io.StringIO("solar power\n\n"))
    capsys.readouterr()
    cli.main(["chat", collection])
    assert "Solar power" in capsys.readouterr().out
    cli.main(["reset", collection])
    assert spark.read.parquet(collection).count() == 0
