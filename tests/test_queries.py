"""Every query with an oracle against DuckDB on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry_point
from lotwise.plans.registry import ORACLE, QUERIES

FOLDER = os.environ.get("LOTWISE_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v if v is None or isinstance(v, (int, str, bool)) else str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    ours = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    result = duck.execute(ORACLE[name])
    theirs_columns = [x[0] for x in result.description]
    assert sorted(theirs_columns) == columns
    at = [theirs_columns.index(c) for c in columns]
    assert ours == sorted(repr([plain(row[k]) for k in at]) for row in result.fetchall())


@needs_data
def test_entry_and_registry(spark):
    assert entry_point.entry(spark).columns[0] == "portfolio_id"
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    assert set(QUERIES) == set(ORACLE)
