"""Every query with SQL gives the rows of its SQL."""

import duckdb
import pytest

from undula.plans import catalog, models, profiles

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(tuple, df.where(df.notna(), None).values.tolist()), key=str)


QUERIES, ORACLE = {**catalog.QUERIES, **models.QUERIES, **profiles.QUERIES}, {**catalog.ORACLE, **models.ORACLE, **profiles.ORACLE}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, sf_dir, sql, name):
    mine, theirs = QUERIES[name](spark, sf_dir).toPandas(), sql.execute(ORACLE[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)
