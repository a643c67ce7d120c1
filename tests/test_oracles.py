"""Every query that has SQL gives what DuckDB gives."""

import math
import os

import duckdb
import pytest

from docquarry.plans import catalog

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)

    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 6) + 0.0
        return v.replace(tzinfo=None) if hasattr(v, "tzinfo") and v is not None else v

    return sorted(([value(r[i]) for i in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = plain(df.collect(), df.columns)
    result = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in result.description]
    want = plain(result.fetchall(), names)
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() >= 0
