"""Every query with SQL against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from waylace import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path}/*.parquet'" if os.path.isdir(path) else f"create view {t} as select * from '{path}'")
    return con


def rows(frame):
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        v = v.item() if hasattr(v, "item") else v
        return round(v, 6) + 0.0 if isinstance(v, float) else v

    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, duck, sf_dir, name):
    assert rows(catalog.queries()[name](spark, sf_dir).toPandas()) == rows(duck.sql(catalog.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_without_sql(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
