"""Registered queries against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from loomquery.plans import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return bytes(v).decode() if isinstance(v, (bytes, bytearray)) else v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    rows = [tuple(norm(v) for v in r) for r in df.collect()]
    if name not in queries.ORACLE_SQL:
        assert rows  # nothing to compare with, but something comes
        return
    other = duck.sql(queries.ORACLE_SQL[name])
    at = [other.columns.index(c) for c in df.columns]
    assert sorted(map(repr, rows)) == sorted(repr(tuple(norm(r[i]) for i in at)) for r in other.fetchall())


def test_these_run_over_the_whole_table(spark, duck):
    for name, of in (("unnest_cross", "(SELECT unnest(string_split(event_type, 'i')) FROM events)"), ("cast_decimal", "lineitem"), ("agg_product", "(SELECT DISTINCT l_orderkey FROM lineitem)")):
        assert queries.QUERIES[name](spark, DATA).count() == duck.sql(f"SELECT count(*) FROM {of}").fetchall()[0][0]
