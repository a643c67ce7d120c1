"""Files as a stream: bad ones apart, lost runs repeated, models that fail in part."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry import cli
from docquarry.functions import slots
from docquarry.plans import streams
from docquarry.sources import files
from docquarry.sources.upserts import UpsertTable
from docquarry.streaming import ingest


def rows(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=repr)


@pytest.fixture
def folder(tmp_path):
    for name, content in {"a.txt": b"Solar owns Wind.\fSecond page.", "b.txt": b"\xc3\x28 broken", "c.txt": "Prose é".encode(), "empty.txt": b" \f "}.items():
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes(content)
    return tmp_path


def take(spark, folder, **more):
    store = ingest.Store(spark, str(folder / "store"))
    ingest.ingest(store, str(folder / "in"), str(folder / "checkpoint"), files.strict_pages, **more)
    return store


def test_a_bad_file_fails_alone_and_is_mended(spark, folder):
    store = take(spark, folder, corpus="green")
    want = [("a", 1, "Solar owns Wind."), ("a", 2, "Second page."), ("c", 1, "Prose é")]
    assert rows(store.pages.read(), "doc_id", "page", "text") == want
    assert [(d, e.split(":")[0]) for d, e in rows(store.dead_letters.read(), "doc_id", "error")] == [("b", "UnicodeDecodeError"), ("empty", "no text")]
    assert ("Solar", "OWNS", "Wind", "a", "green") in rows(store.edges.read(), "src", "rel", "dst", "doc_id", "corpus_id")
    assert rows(ingest.progress(store), "files", "failed", "pages", "chunks") == [(4, 2, 3, 3)]
    (folder / "in" / "fixed").mkdir()
    (folder / "in" / "fixed" / "b.txt").write_bytes(b"now it reads")
    store = take(spark, folder, nested=True)
    assert rows(store.pages.read(), "doc_id", "page", "text") == [want[0], want[1], ("b", 1, "now it reads"), want[2]]
    assert rows(store.dead_letters.read(), "doc_id") == [("empty",)]
    store.delete(spark.createDataFrame([("a",)], "doc_id string"))
    assert {r[0] for t in ("pages", "points", "edges", "log") for r in rows(store.tables()[t].read(), "doc_id")} == {"b", "c", "empty"}


@pytest.mark.parametrize("lost", ["points", "dead_letters", "log"])
def test_a_lost_run_goes_on(spark, folder, monkeypatch, lost):
    commit = UpsertTable.commit

    def broken(self, *args, **more):
        if self.path.endswith(lost):
            raise OSError("lost")
        return commit(self, *args, **more)

    monkeypatch.setattr(UpsertTable, "commit", broken)
    with pytest.raises(Exception, match="lost"):
        take(spark, folder, files_each=2)
    monkeypatch.undo()
    store = take(spark, folder, files_each=2)
    assert rows(store.pages.read(), "doc_id", "page") == [("a", 1), ("a", 2), ("c", 1)]
    assert rows(store.log.read(), "doc_id", "status") == [("a", "ok"), ("b", "failed"), ("c", "ok"), ("empty", "failed")]
    assert store.points.read().count() == 3
    versions = store.pages.versions()
    take(spark, folder)
    assert store.pages.versions() == versions


def test_one_document_of_two_files(spark, tmp_path):
    for part in ("x", "y"):
        (tmp_path / "in" / part).mkdir(parents=True)
        (tmp_path / "in" / part / "one.txt").write_text(f"from {part}")
    store = take(spark, tmp_path, nested=True)
    assert rows(store.pages.read(), "doc_id", "text") == [("one", "from y")]
    assert rows(store.log.read(), "status", "chunks") == [("ok", 1), ("replaced", None)]


def test_a_model_fails_in_part(spark, folder, monkeypatch):
    calls = []

    def picky(texts):
        if any("Second" in t for t in texts):
            raise ValueError("refused")
        return [np.ones(4)] * len(texts)

    monkeypatch.setitem(slots._SLOTS, "embed", picky)
    store = take(spark, folder)
    assert rows(store.points.read(), "doc_id", "page") == [("a", 1), ("c", 1)]
    assert rows(store.log.read().where("status = 'ok'"), "doc_id", "chunks", "refused") == [("a", 2, 1), ("c", 1, 0)]

    def flaky(items):
        calls.append(len(items))
        if 7 in items or len(calls) % 4 == 0:
            raise RuntimeError("busy")
        return items

    found = slots.salvaged(flaky, list(range(50)))
    assert [x for x, e in found if e is None] == [i for i in range(50) if i != 7] and found[7] == (None, "RuntimeError: busy")
    assert slots.salvaged(lambda x: x[:-1], [1, 2])[0][1].startswith("ValueError") and slots.salvaged(len, []) == []


def test_counts_by_document_once(spark, monkeypatch):
    """Triples of whole texts with a model that fails for some rows: each document is counted once, in one pass."""
    texts = [(i, f"Alpha{i} owns Beta{i}. Alpha{i} produces Gamma." + (" poison" if i % 10 == 3 else "")) for i in range(700)]

    def model(batch):
        if any("poison" in t for t in batch):
            raise ValueError("poison")
        return slots.triples(batch)

    monkeypatch.setitem(slots._SLOTS, "triples", model)
    made = slots.called(spark.createDataFrame(texts, "doc_id long, text string"), "triples", "text", "array<struct<src:string,rel:string,dst:string>>", "triples", "error", lambda t: [dict(zip(("src", "rel", "dst"), x)) for x in t])
    counts = made.groupBy("doc_id").agg(F.sum(F.when(F.col("error").isNull(), F.size("triples"))).alias("n"), F.count("error").alias("bad"))
    assert rows(counts, "doc_id", "n", "bad") == sorted(((i, None if i % 10 == 3 else 2, int(i % 10 == 3)) for i, _ in texts), key=repr)


def test_on_the_command_line(spark, folder, capsys):
    store = str(folder / "store")
    cli.main(["ingest", str(folder / "in" / "*.txt"), store])
    assert "UnicodeDecodeError" in capsys.readouterr().out
    cli.main(["query", store, "Solar owns what?"])
    assert "Solar" in capsys.readouterr().out
    cli.main(["delete", store, "a"])
    cli.main(["list-docs", store])
    out = capsys.readouterr().out
    assert "|c " in out and "|a " not in out
    cli.main(["reset", store])
    assert ingest.Store(spark, store).points.read().count() == 0


def test_queries_share_an_ingest(spark, monkeypatch):
    took, folder = [], "/root/testdata/sf0.001"
    ingested = ingest.ingest
    monkeypatch.setattr(ingest, "ingest", lambda *a, **b: (took.append(1), ingested(*a, **b))[1])
    monkeypatch.setattr(streams.stored, "_BUILT", {})
    assert streams.ingest_pages(spark, folder).count() > 0 and streams.ingest_log(spark, folder).count() == 2
    assert len(took) == 1


def test_steps_at_a_time_raise_when_all_have_ended(spark):
    done = []

    def bad():
        raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        ingest._together(spark, bad, lambda: done.append(1))
    assert done == [1]


def test_embed_counts_the_tokens_of_words():
    """Words are kept whole, so signs, figures, CJK letters and all kinds of blanks must give the tokens that the splitter gives."""
    texts = ["Solar, wind; (2023) x_y", "營收 2023年 a\x1cb\u00a0c\u2003d", "", None, "İSTANBUL ǅ!", "word " * 50 + "-" * 100]
    for row, text in zip(slots.embed(texts), texts):
        want = np.zeros(slots.DIMENSIONS, np.float32)
        for token in slots.segment((text or "").lower()):
            if token.strip():
                h = slots.hashlib.blake2b(token.encode(), digest_size=4).digest()
                want[int.from_bytes(h[:2], "little") % slots.DIMENSIONS] += 1 if h[2] & 1 else -1
        assert row.tolist() == (want / max(np.linalg.norm(want), 1e-12)).tolist()


def test_files_are_listed_by_few_tasks(spark, tmp_path, monkeypatch):
    """Else a batch starts a task for each of its files before it reads them."""
    name, seen = "spark.sql.sources.parallelPartitionDiscovery.parallelism", []
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("a")
    before = spark.conf.get(name)
    monkeypatch.setattr(ingest, "ingest_batch", lambda store, batch, *more: seen.append(batch.sparkSession.conf.get(name)))
    take(spark, tmp_path)
    assert seen == ["64"] and spark.conf.get(name) == before
