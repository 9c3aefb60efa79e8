"""Every query against its SQL in DuckDB, over the same tables."""

import datetime
import decimal
import math

import duckdb
import pytest
from ledgerloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, decimal.Decimal):
        return round(float(x), 6)
    if isinstance(x, list | tuple):
        return tuple(plain(y) for y in x)
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return x


def table(columns, rows):
    order = sorted(columns)
    return sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(name, spark, sf_dir, duck):
    frame = catalog.QUERIES[name](spark, sf_dir)
    got = duck.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(frame.columns)
    assert table(frame.columns, [tuple(r) for r in frame.collect()]) == table(columns, got.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_gives_rows(name, spark, sf_dir):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0
