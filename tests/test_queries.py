"""Every registered query against its DuckDB oracle on the smallest driver tables (order-insensitive, rounded)."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from indexspark.sources.tables import TABLE_NAMES

SF = os.environ.get("INDEXSPARK_TEST_SF", "/root/testdata/sf0.001")
from indexspark.plans import registry  # noqa: E402

registry.load_all()
QUERIES, ORACLES = dict(registry.QUERIES), dict(registry.ORACLES)  # the llm queries have tests of their own


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if (math.isnan(v) or math.isinf(v)) else round(v, 6)
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    out = [tuple(_norm(x) for x in rec) for rec in pdf[cols].itertuples(index=False)]
    return cols, sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLE_NAMES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_a_callable():
    assert len(QUERIES) >= 100
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    sc, sr = _rows(QUERIES[name](spark, SF).toPandas())
    dc, dr = _rows(con.execute(ORACLES[name]).df())
    assert sc == dc
    assert len(sr) == len(dr)
    assert sr == dr


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() >= 0 and len(df.columns) > 0


def test_entry(spark):
    df = E.entry(spark)
    assert set(df.columns) == {"goal", "dimension", "region_id", "score"}
    assert df.count() > 0
