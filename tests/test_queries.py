"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import entry, oracle_sql, queries

BUILDS, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{folder}/{name}'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        text = df[c].dtype == object or pd.api.types.is_bool_dtype(df[c])
        df[c] = df[c].map(lambda v: None if v is None else str(v)) if text else df[c].astype("float64")
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, spark, duck, folder):
    got = BUILDS[name](spark, folder).toPandas()
    want = duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    pd.testing.assert_frame_equal(normal(got), normal(want), check_dtype=False)


@pytest.mark.parametrize("name", sorted(set(BUILDS) - set(SQL)))
def test_runs(name, spark, folder):
    assert BUILDS[name](spark, folder).count() > 0


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["image_id", "channel", "value", "n"]
    assert df.count() > 0


def test_no_cross_joins(spark, folder):
    """No plan contains a cartesian product; nested loops appear nowhere."""
    for name, build in BUILDS.items():
        if name.startswith(("save_", "op", "pipeline")):  # these run jobs while they are built
            continue
        plan = build(spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
        assert "NestedLoop" not in plan, name
