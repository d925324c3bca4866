"""Every query with SQL against DuckDB over the smallest tables."""

import duckdb
import pytest

from tidewave.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    columns = sorted(df.columns)
    return sorted(map(tuple, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert rows(catalog.queries()[name](spark, SF).toPandas()) == rows(db.sql(catalog.oracle_sql()[name]).df())
