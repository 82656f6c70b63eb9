"""Each query against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from lidaraudit.plans import registry
from tests.conftest import SMALL

TABLES = ("events", "lineitem", "embeddings")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list:
    names = sorted(df.columns)
    plain = df[names].astype(object).where(df[names].notna(), None)
    text = lambda v: "null" if v is None else str(float(v) + 0.0) if isinstance(v, float) else str(v)
    return sorted(tuple(map(text, r)) for r in plain.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = registry.queries()[name](spark, SMALL).toPandas()
    want = duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    """Queries that SQL can't express: their operators are tested against plain versions."""
    assert registry.queries()[name](spark, SMALL).count() > 0
