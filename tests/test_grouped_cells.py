"""Cells of a row come together by grouping: no side of a join can be sent to the driver, whatever Spark takes its size for."""

import re

from docquarry.operators import tables


def test_observations_and_texts_have_no_join(spark, tmp_path):
    rows = [("d", "t", r, c, col, val) for r in range(3) for c, (col, val) in enumerate([("name", f"n{r} (x)"), ("size", str(r)), ("name", "last"), ("note", " ")])]
    rows += [("d", "u", 0, 0, "size", "7"), (None, "t", 0, 0, "name", "lost")]
    spark.createDataFrame(rows, "doc_id string, table_id string, row_idx long, col_idx int, col string, val string").write.parquet(str(tmp_path / "cells"))
    cells = spark.read.parquet(str(tmp_path / "cells"))
    obs = tables.observations(cells)
    texts = tables.table_texts(obs)
    for df in (obs, texts):
        assert not re.search("Join|BroadcastExchange", df._jdf.queryExecution().executedPlan().toString())
    got = sorted((r.table_id, r.row_idx, r.col_idx, r.metric_leaf, r.dimensions, r.value_num, r.panel) for r in obs.collect())
    want = [("t", r, *x) for r in range(3) for x in ((0, "name", {"name": "last"}, None, f"n{r}"), (1, "size", {"name": "last"}, float(r), f"n{r}"), (2, "name", {"name": f"n{r} (x)"}, None, f"n{r}"))]
    assert got == [*want, ("u", 0, 0, "size", {}, 7.0, "")]
    assert sorted(map(tuple, texts.collect())) == [("d", "t", "n0, n1, n2 | name, size | n0 (x), 0, last"), ("d", "u", " | size | 7")]
