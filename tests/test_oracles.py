"""Every query of the engine that SQL can express, against that SQL, on the smallest tables."""

import datetime as dt
import glob
import math
import os

import duckdb
import pytest

from stepwright import plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
QUERIES, ORACLES = plans.collect() if os.path.isdir(SF) else ({}, {})


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def cell(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5)
    if hasattr(value, "as_tuple"):
        return round(float(value), 5)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(cell(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(cell(r[c]) for c in columns) for r in got.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows and len(rows[0].__fields__) == len(set(rows[0].__fields__))
