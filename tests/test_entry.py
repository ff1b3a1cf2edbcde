import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


def test_names():
    assert set(SQL) <= set(QUERIES)
    assert all(callable(f) for f in QUERIES.values())


def rows(frame):
    frame = frame[sorted(frame.columns)]
    show = lambda v: "NULL" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(v) for v in r) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.partition('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        assert rows(frame) == rows(duck.execute(SQL[name]).fetchdf())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
