import pytest
from pyspark.sql import functions as F

from docquarry.operators import requests
from docquarry.plans import service
from docquarry.plans.shared_folder import cut_lineage

ASKED = "query_id long, query string, top_k int, threshold double, doc_ids array<string>, pages array<int>, types array<string>, equal map<string,array<string>>, vector array<double>"


@pytest.fixture(scope="module")
def points(spark):
    """Forty points of four documents, two thirds of them in one, on a circle; every third is a table's."""
    import math

    rows = []
    for i in range(40):
        doc = "hot" if i % 3 else f"cold{i % 4}"
        kind = ("table_summary", "table_row", "paragraph")[i // 2 % 3]
        rows.append((i, doc, i % 5, kind, "de" if i % 2 else "en", f"word{i % 7} power of {doc} number{i}", [math.cos(i / 7), math.sin(i / 7)]))
    return spark.createDataFrame(rows, "id long, doc_id string, page int, type string, lang string, text string, embedding array<double>").checkpoint()


ROWS = [
    (1, "power", 3, 0.0, None, None, None, None, [1.0, 0.0]),
    (2, "word3", 4, 0.2, ["hot"], None, None, None, [0.0, 1.0]),
    (3, "word3", 4, 0.0, ["hot", "cold0!"], [1, 2], None, {"lang": ["de"]}, [0.5, 0.5]),
    (4, "revenue table", 5, 0.0, None, None, None, None, [-1.0, 0.2]),
    (5, "power of nowhere", 2, 0.5, ["nowhere"], None, None, None, [0.3, 0.9]),
    (6, "power", 2, 0.999999, ["cold0"], [4], None, {"lang": ["fr"]}, [0.3, -0.9]),
    (7, "number7 on page 2", 6, 0.0, None, None, ["paragraph"], None, [-1.0, 0.2]),
    (8, "in cold1 power", 9, 0.0, None, None, None, None, [0.1, 0.7]),
]


def asked(spark, rows):
    return spark.createDataFrame(rows, ASKED)


def results(df):
    return sorted(tuple(r) for r in df.select("query_id", "final_rank", "id", "score").collect())


def test_a_request_gets_the_same_alone_and_among_others(spark, points):
    known = points.select("doc_id").distinct()
    together = results(requests.retrieve(points, asked(spark, ROWS), cut_lineage, known))
    for r in (ROWS[2], ROWS[5], ROWS[7]):
        assert results(requests.retrieve(points, asked(spark, [r]), cut_lineage, known)) == [row for row in together if row[0] == r[0]]
    assert {row[0] for row in together} == {r[0] for r in ROWS}


def test_rungs_of_the_ladder(spark, points):
    near = requests.retrieve(points, asked(spark, ROWS), cut_lineage, engine="vector")
    docs = {}
    for r in near.collect():
        docs.setdefault(r.query_id, set()).add((r.doc_id, r.page, r.id))
    assert {d for d, _, _ in docs[2]} == {"hot"}  # under its documents
    assert {d for d, _, _ in docs[3]} <= {"hot", "cold0"} and {p for _, p, _ in docs[3]} <= {1, 2} and all(i % 2 for _, _, i in docs[3])
    assert {d for d, _, _ in docs[5]} & {"hot", "cold0", "cold1", "cold2", "cold3"}  # of all documents, as nothing is in its own
    assert {d for d, _, _ in docs[6]} == {"cold0"}  # the first points of its documents, as no point has its language


def test_questions_say_constraints(spark, points):
    known = points.select("doc_id").distinct()
    own = {r.query_id: r for r in requests.parsed(requests.completed(asked(spark, ROWS)), known).collect()}
    assert own[7].pages == [2] and own[7].query == "number7 on"
    assert own[8].doc_ids == ["cold1"] and own[8].query == "in power"
    assert own[4].types == ["table_row", "table_summary"] and own[4].tables and own[4].query == "revenue"
    assert own[3].doc_ids == ["hot", "cold0"]


def test_odd_requests_and_points(spark, points):
    rows = [(1, None, 3, 0.0, None, None, None, None, [1.0, 0.0]), (2, "  ", 3, 0.0, None, None, None, None, [1.0, 0.0]), (None, "power", 3, 0.0, None, None, None, None, [1.0, 0.0]), (3, "power", None, None, None, None, None, None, None), (4, "power", 99, 7.0, [], [], [], {}, [float("nan"), 0.0]), (5, "power", -4, -1.0, None, None, None, None, [1.0])]
    more = points.limit(0).union(spark.createDataFrame([(90, None, None, None, None, None, None), (91, "hot", 1, "paragraph", "en", "", []), (None, "hot", 1, "paragraph", "en", "power", [1.0, 0.0])], points.schema))
    got = requests.retrieve(points.unionByName(more).withColumn("score", F.lit(1)).withColumn("rank", F.lit(2)), asked(spark, rows), cut_lineage)
    counts = {r["query_id"]: r["count"] for r in got.groupBy("query_id").count().collect()}
    assert set(counts) == {3, 4, 5} and counts[5] == 1 and counts[3] == 6
    assert requests.retrieve(points.limit(0), asked(spark, ROWS), cut_lineage).count() == 0
    assert requests.retrieve(points, asked(spark, ROWS).limit(0), cut_lineage).count() == 0
    with pytest.raises(ValueError):
        requests.retrieve(points, asked(spark, [(1, "power", 3, 0.0, None, None, None, {"nothing": ["x"]}, [1.0, 0.0])]), cut_lineage, engine="vector")


def test_blocks_of_requests(spark, points, monkeypatch):
    whole = results(requests.retrieve(points, asked(spark, ROWS), cut_lineage))
    monkeypatch.setattr(requests.search, "QUERY_BLOCK", 3)
    monkeypatch.setattr(requests, "STEP", 6)
    assert results(requests.retrieve(points, asked(spark, ROWS), cut_lineage)) == whole


def test_the_plan_does_not_grow_with_the_constraints(spark, points):
    def size(n):
        rows = [(i, "power", 3, 0.0, [f"cold{i}"], [i], None, {"lang": [str(i)]}, [1.0, 0.0]) for i in range(n)]
        return len(requests.dense(points, requests.completed(asked(spark, rows)).withColumn("must", F.create_map(F.lit("page"), F.col("pages").cast("array<string>"))).withColumn("pool", F.lit(18)))._jdf.queryExecution().optimizedPlan().toString())

    assert size(40) - size(2) < 100


def test_values_of_the_service(spark, points):
    own = points.withColumn("num", F.col("id")).withColumn("id", F.concat(F.lit("chunk"), F.col("id").cast("string"))).drop("embedding").withColumn("embedding", F.array(F.lit(1.0), F.col("num").cast("double")))
    got = service.retrieve(own, [service.Request("power", 5, equal={"lang": "de"}), service.Request("power", 5, pages=(2,), equal={"lang": ["en", "de"]})], "keyword").collect()
    assert {r.query_id for r in got} == {0, 1} and all(int(r.id[5:]) % 2 for r in got if r.query_id == 0) and {r.page for r in got if r.query_id == 1} == {2}
