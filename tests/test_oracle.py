"""Every registered core query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from quern.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings chunks file_register feedback_logs chat_sessions golden_queries mix_targets".split()
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v.replace(tzinfo=None).isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    mine = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    rel = con.sql(SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert mine == sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert len(df.columns) == len(set(df.columns)) and df.count() > 0


def test_results_do_not_depend_on_partitions(spark, sf):
    got = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append([sorted(map(str, QUERIES[q](spark, sf).collect())) for q in ("bm25_topk", "hybrid_search", "select_context", "chunk_children")])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1]
