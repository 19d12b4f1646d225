"""Every registered query that has SQL gives the SQL's rows, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SQL = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("op") and k != "pipeline"}


def rows(df: pd.DataFrame) -> list[str]:
    def one(v):
        if not isinstance(v, (list, dict)) and not hasattr(v, "shape") and pd.isna(v):
            return None
        if isinstance(v, float):
            return int(v) if v == int(v) else round(v, 9)
        return v.item() if hasattr(v, "item") else v

    return sorted(repr(tuple(one(v) for v in r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0
