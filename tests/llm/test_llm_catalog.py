import glob
import os

import pytest

from brindle.llm import queries as llm

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
COLUMNS = {
    "p1_found": ["kind", "record_id", "ref_id"], "p2_found": ["term", "mark"], "p3_found": ["doc_id_a", "doc_id_b"], "p4_found": ["doc_id", "term"], "p5_found": ["doc_id", "syntax", "element"],
    "p6_found": ["query"], "p7_found": ["table_name", "keep_id", "copy_id"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id"],
}


def plain(v):
    return round(v, 7) if isinstance(v, float) else v


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_other_tables(spark, tmp_path):
    spark.createDataFrame([(1, "\uff21 b"), (2, None)], "doc_id bigint, content string").write.parquet(f"{tmp_path}/docs.parquet")
    assert rows(llm.p1_canonical_docs(spark, str(tmp_path))) == [(1, "a b"), (2, None)]
    stats = [(1, "A  b", 7), (2, "a b", 7), (3, "a b", 8), (4, None, 7)]
    spark.createDataFrame(stats, "stat_id bigint, query string, instance_id bigint").write.parquet(f"{tmp_path}/query_stats.parquet")
    assert rows(llm.p7_collapsed_stats(spark, str(tmp_path))) == [(1, 2), (3, 1), (4, 1)]


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_against_sql(spark, name):
    df = llm.queries()[name](spark, SF)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    got = sorted(repr(tuple(map(plain, r))) for r in df.collect())
    if statement := llm.oracle_sql().get(name):
        c = duckdb.connect()
        for f in glob.glob(f"{SF}/*.parquet"):
            c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
        r = c.execute(statement)
        at = [[d[0] for d in r.description].index(x) for x in df.columns]
        assert got == sorted(repr(tuple(plain(row[i]) for i in at)) for row in r.fetchall())
