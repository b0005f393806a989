"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from lattica.catalog import TABLES
from lattica.plans import annotated, arrays, fields, flows, layers, relational, taskdb, training, versions, volume

PLANS = (volume, relational, annotated, flows, arrays, layers, taskdb, training, fields, versions)
QUERIES = {name: f for plan in PLANS for name, f in plan.QUERIES.items()}
ORACLES = {name: sql for plan in PLANS for name, sql in plan.ORACLES.items()}


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{data}/{name}.parquet"
        con.execute(f"create view {name} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def value(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
        return None
    if isinstance(v, (float, np.floating)):
        return round(float(v), 6)
    return v.item() if hasattr(v, "item") else v


def rows(df):
    return sorted(repr(tuple(value(r[c]) for c in sorted(r))) for r in df.to_pylist())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, data, duck, name):
    got, want = QUERIES[name](spark, data).toArrow(), duck.sql(ORACLES[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)


def test_entry_has_rows(spark, data):
    import __spark_entry__

    assert volume.q12_contact_pipeline(spark, data).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["q19_blend_linear", "q20_blend_quadratic", "q21_blend_bump", "q22_blend_max"])
def test_blends_take_all_events(spark, tmp_path, name):
    """12,300 events in 25 chunks, the last one part full: no event is lost."""
    events = pd.DataFrame({"event_id": np.arange(12_300), "value": np.arange(12_300) * 0.7 % 13 - 2})
    events.to_parquet(tmp_path / "events.parquet")
    got = QUERIES[name](spark, str(tmp_path)).toArrow()
    assert got.num_rows == len(events)
    assert rows(got) == rows(duckdb.sql(ORACLES[name]).to_arrow_table())


def test_blends_of_no_events(spark, tmp_path):
    pd.DataFrame({"event_id": np.zeros(0, np.int64), "value": np.zeros(0)}).to_parquet(tmp_path / "events.parquet")
    assert volume.QUERIES["q19_blend_linear"](spark, str(tmp_path)).count() == 0
