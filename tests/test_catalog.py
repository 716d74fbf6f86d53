"""Every query with SQL gives the SQL's rows, on the smallest tables."""

import math

import duckdb
import pytest

from lexloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_match(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    cur = duck.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == names
    want = sorted(repr([plain(dict(zip(cols, r, strict=True))[c]) for c in names]) for r in cur.fetchall())
    assert got == want


def test_no_query_depends_on_its_input_partitions(spark):
    base = catalog.queries()["rrf_fusion"](spark, SF).collect()
    from lexloom.operators import rank
    from lexloom.plans.queries_search import _events

    again = rank.rrf_fusion(_events(spark, SF).withColumnRenamed("rank", "retrieval_rank").repartition(7)).collect()
    assert sorted(map(repr, base)) == sorted(map(repr, again))
