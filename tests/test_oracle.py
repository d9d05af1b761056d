"""Every query that has oracle SQL gives the same rows in both engines."""

import duckdb
import pandas as pd
import pytest

from skirmish.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLE = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(df):
    def value(v):
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return "null"
        if isinstance(v, str):
            return v
        return f"{float(v):.9g}" if not isinstance(v, (bool,)) else str(bool(v))

    df = df[sorted(df.columns)]
    return sorted(tuple(value(v) for v in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, sf_dir, duck, name):
    got, want = registry.queries()[name](spark, sf_dir).toPandas(), duck.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_every_query_has_a_name_of_its_own():
    assert set(ORACLE) <= set(registry.queries())
