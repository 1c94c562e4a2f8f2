import importlib
import os

import duckdb
import pandas as pd
import pytest

from tandem.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{name}')")
    return c


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df:
        if pd.api.types.is_float_dtype(df[c]):
            df[c] = df[c].round(5) + 0.0
    return df.astype(str).sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_equals_sql(spark, oracle, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), oracle.execute(ORACLES[name]).df()
    pd.testing.assert_frame_equal(plain(got), plain(want))


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_others_run(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
