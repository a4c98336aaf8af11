"""Every query with SQL gives what DuckDB gives."""

import math

import duckdb
import pytest

from thermoline.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    with duckdb.connect() as c:
        for t in TABLES:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        yield c


def plain(rows):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return v if isinstance(v, (bool, str)) else str(v) if hasattr(v, "isoformat") else float(v)

    return sorted((tuple(one(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    got = plain(rows)
    want = db.sql(sql)
    assert sorted(want.columns) == columns
    want = plain(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert got == want
