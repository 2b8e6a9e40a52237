"""Every query that has SQL gives what DuckDB gives; the others give rows."""

import os

import duckdb
import pandas as pd
import pytest

from tallyloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")


def plain(frame):
    def value(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        return None if v is None or (not isinstance(v, list) and pd.isna(v)) else v

    columns = sorted(frame.columns)
    return columns, sorted(repr([value(v) for v in row]) for row in frame[columns].astype(object).values.tolist())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    assert plain(catalog.QUERIES[name](spark, SF).toPandas()) == plain(duck.execute(catalog.ORACLE_SQL[name]).fetchdf())


@needs_data
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
