"""Every query against its SQL, at the smallest scale."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from trackloom.plans import registry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


def table(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def compare(spark, con, name, query, sql):
    df = query(spark, SF)
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns), name
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(want.columns, want.fetchall())


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, name):
    compare(spark, connect(), name, registry.QUERIES[name], registry.ORACLE_SQL[name])
