"""Every named query next to its SQL.

Row keys made from order, line and supplier are unique from sf0.01 on, so that is
the scale used here.
"""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from geoloom import catalog

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    return v


FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(catalog.ORACLES) == set(catalog.QUERIES)
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["tile_x", "tile_y", "n", "zoom"]


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted((tuple(canon(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    rel = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    want = sorted((tuple(canon(r[i]) for i in order) for r in rel.fetchall()), key=repr)
    assert cols == sorted(names)
    assert got == want
