"""Every query against its SQL over the smallest tables."""

import duckdb
import pandas as pd
import pytest
from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def text(frame: pd.DataFrame, names: list[str]) -> list[tuple]:
    show = lambda v: "null" if v is None or v is pd.NaT or v != v else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(show(v) for v in row) for row in frame[names].itertuples(index=False))


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n in catalogue.SQL])
def test_query_equals_sql(spark, con, name):
    got, expected = catalogue.QUERIES[name](spark, SF).toPandas(), con.sql(catalogue.SQL[name]).df()
    names = sorted(expected.columns)
    assert sorted(got.columns) == names
    assert text(got, names) == text(expected, names)


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in catalogue.SQL])
def test_query_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
