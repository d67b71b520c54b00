import datetime
import decimal
import os

import duckdb
import pytest

from millrace.plans.queries import ORACLES, QUERIES


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted([plain(r[c]) for c in cols] for r in df.collect()) == sorted([plain(r[i]) for i in at] for r in want.fetchall())


def test_densify_and_union_with_take_whole_tables(spark, sf, duck):
    rows = {name: QUERIES[name](spark, sf).collect() for name in ("densify_whole", "union_with_whole")}
    assert len(rows["densify_whole"]) == duck.sql("SELECT count(DISTINCT user_id) FROM events").fetchall()[0][0]
    assert sum(r["events"] for r in rows["densify_whole"]) == duck.sql("SELECT count(*) FROM events").fetchall()[0][0]
    assert len(rows["union_with_whole"]) == duck.sql("SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)").fetchall()[0][0]
