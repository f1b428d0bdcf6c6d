"""Every query with SQL gives DuckDB's rows, and some; the others give some."""

import os

import duckdb
import pytest

from marginalia.plans.all_queries import ORACLES, QUERIES, flagship

DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def rounded(v):
    return round(v, 6) if isinstance(v, float) else tuple(map(rounded, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("name", QUERIES)
def test_rows_equal_those_of_sql(spark, con, name):
    frame = QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    rows = sorted((tuple(rounded(r[c]) for c in columns) for r in frame.collect()), key=str)
    assert rows
    if name in ORACLES:
        result = con.execute(ORACLES[name])
        names = [x[0] for x in result.description]
        assert sorted(names) == columns
        assert rows == sorted((tuple(rounded(x[names.index(c)]) for c in columns) for x in result.fetchall()), key=str)


def test_the_flagship_query(spark):
    assert flagship(spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["a3_conditional_counts"](spark, DATA)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<o_orderstatus:string,o_orderpriority:string>" in plan
    plan = QUERIES["j2_semi_labels"](spark, DATA)._jdf.queryExecution().toString()
    assert "EqualTo(toxic,1)" in plan
