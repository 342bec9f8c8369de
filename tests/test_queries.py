"""Every registered coordination query against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from coordspark.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def rows(df):
    plain = lambda v: None if v is None or v is pd.NA or v != v else round(v, 6) if isinstance(v, float) else v
    return sorted(repr(tuple(plain(v) for v in r)) for r in df[sorted(df.columns)].astype(object).to_numpy().tolist())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, FOLDER).toPandas()
    if name in registry.ORACLE_SQL:
        want = duck.execute(registry.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
