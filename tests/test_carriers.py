"""Each carrier query equals its SQL on the smallest tables."""

import math

import duckdb
import pytest

from sievework.plans import carriers, page_queries, review_queries, source_queries

DATA = "/root/testdata/sf0.001"
QUERIES = carriers.QUERIES | source_queries.QUERIES | page_queries.QUERIES | review_queries.QUERIES
ORACLES = carriers.ORACLES | source_queries.ORACLES | page_queries.ORACLES | review_queries.ORACLES
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, db, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    cur = db.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_changed_lines_of_odd_texts(spark, tmp_path):
    rows = list(enumerate(["", None, "a", "a\n", "\n", "\r\n", "\na\n", "a\nb", "a\ra\r"]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in QUERIES["changed_lines"](spark, str(tmp_path)).select("doc_id", "added", "removed").collect()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(con.execute(ORACLES["changed_lines"]).fetchall())
