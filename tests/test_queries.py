"""Every query with SQL against DuckDB, and the contract's functions."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from tidemark.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def plain(pdf):
    def cell(x):
        return round(float(x), 5) + 0.0 if isinstance(x, (int, float, np.number, bool)) else str(x)

    return sorted(tuple("" if pd.isna(x) else str(cell(x)) for x in r) for r in pdf[sorted(pdf.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, sf, db, name):
    a, b = queries.QUERIES[name](spark, sf).toPandas(), db.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and plain(a) == plain(b)


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["ref_shoreline_lookup", "bucket_by_period"])
def test_lookup_of_repeated_scenes(spark, db, tmp_path, name):
    """Orders of one customer at one time whose keys end alike are one scene; some orders have no time or no customer."""
    path = str(tmp_path / "orders.parquet")
    odd = "SELECT * REPLACE (CASE WHEN o_orderkey % 5 = 1 THEN NULL ELSE o_orderdate END AS o_orderdate, CASE WHEN o_orderkey % 5 = 2 THEN NULL ELSE o_custkey END AS o_custkey) FROM orders WHERE o_orderkey < 20"
    db.sql(f"COPY (SELECT * FROM orders UNION ALL SELECT * REPLACE (o_orderkey + 100000 AS o_orderkey) FROM orders UNION ALL {odd}) TO '{path}' (FORMAT parquet)")
    a = queries.QUERIES[name](spark, str(tmp_path)).toPandas()
    own = queries.ORACLE_SQL[name].replace("FROM orders", f"FROM read_parquet('{path}')")
    b = db.sql(own).df()
    assert own != queries.ORACLE_SQL[name] and plain(a) == plain(b)
