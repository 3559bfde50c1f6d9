import datetime
import glob
import math
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
NAMES = sorted(n for n in entry.queries() if n.startswith("q_"))


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, sql, name):
    df = entry.queries()[name](spark, SF)
    got = df.collect()
    statement = entry.oracle_sql().get(name)
    if statement is None:
        return
    r = sql.execute(statement)
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted((tuple(plain(x[names.index(c)]) for c in df.columns) for x in r.fetchall()), key=repr)
    assert sorted((tuple(plain(x) for x in row) for row in got), key=repr) == expected


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "score"]
