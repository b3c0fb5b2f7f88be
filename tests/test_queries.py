"""Every query of the registry against its SQL, or at least to its end, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from slackline.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(small):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def plain(value):
    if pd.isna(value):
        return None
    if isinstance(value, float):  # whole numbers beside nulls are floats in one client and integers in the other
        return str(int(value)) if value.is_integer() else round(value, 4)
    return str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, small, name):
    got = QUERIES[name](spark, small).toPandas()
    if name not in ORACLES:
        assert len(got.columns)
        return
    want = sql.execute(ORACLES[name]).fetchdf()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    rows = lambda df: sorted((tuple(plain(v) for v in r) for r in df[columns].astype(object).itertuples(index=False)), key=repr)
    assert rows(got) == rows(want)
