"""Every data-quality query against its SQL on the smallest tables, as the driver does on larger ones."""

import datetime
import decimal
import math
import os
from collections import Counter

import duckdb
import pytest

from dataloom.plans import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf, oracle, name):
    frame = QUERIES[name](spark, sf)
    columns = sorted(frame.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    found = oracle.execute(ORACLE_SQL[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    assert len(at) == len(found.description)
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_queries_without_sql_run(spark, sf):
    for name in set(QUERIES) - set(ORACLE_SQL):
        assert QUERIES[name](spark, sf).columns


def test_entry(spark):
    import __spark_entry__ as e
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
