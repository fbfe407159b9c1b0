import datetime
from collections import Counter

import duckdb
import pytest

from flowloom.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return round(v, 9)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", queries.SQL)
def test_query_equals_its_sql(spark, oracle, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = oracle.sql(queries.SQL[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert Counter(tuple(norm(r[c]) for c in cols) for r in df.collect()) == Counter(tuple(norm(r[i]) for i in at) for r in want.fetchall())


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
