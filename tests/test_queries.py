"""Every query with a SQL twin against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from lumora import catalog, registry

catalog.load()
NAMES = sorted(registry.ORACLES)


def rows(df):
    out = []
    for r in df[sorted(df.columns)].itertuples(index=False):
        row = []
        for v in r:
            if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)) or v is pd.NA:
                row.append("null")
            elif hasattr(v, "item"):
                row.append(f"{float(v.item()):.6f}" if not isinstance(v.item(), (str, bool)) and not hasattr(v, "isoformat") else str(v))
            elif isinstance(v, (int, float)) and not isinstance(v, bool):
                row.append(f"{float(v):.6f}")
            else:
                row.append(str(v))
        out.append(tuple(row))
    return sorted(out)


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"create view {f.split('.')[0]} as select * from '{small}/{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, small, duck, name):
    got, want = registry.QUERIES[name](spark, small).toPandas(), duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, small, name):
    df = registry.QUERIES[name](spark, small)
    assert df.columns
    df.write.format("noop").mode("overwrite").save()
