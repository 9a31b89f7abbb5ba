"""Every query that has SQL gives the rows that DuckDB gives for it, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    return con


def rows(frame):
    frame = frame.reindex(sorted(frame.columns), axis=1).astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted((tuple(x.item() if hasattr(x, "item") else x for x in r) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the standard tables aren't here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    ours, sql = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(sql.columns)
    assert len(ours) > 0
    assert rows(ours) == rows(sql)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_keyword_offsets_are_limited_before_the_shuffle(spark):
    plan = QUERIES["keyword_search"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
