"""Every query with SQL gives the same rows as the SQL, over the smallest tables."""

import os

import pytest

from gacetilla.plans import queries as Q

FOLDER = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for p in os.listdir(FOLDER):
        c.sql(f"CREATE VIEW {p.split('.')[0]} AS SELECT * FROM '{FOLDER}/{p}'")
    return c


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", list(Q.queries()))
def test_query(spark, db, name, tmp_path):
    out = f"{tmp_path}/{name}"
    Q.queries()[name](spark, FOLDER).write.parquet(out)
    if name in Q.oracle_sql():
        db.sql(f"CREATE OR REPLACE TABLE o AS {Q.oracle_sql()[name]}")
        db.sql(f"CREATE OR REPLACE TABLE m AS SELECT * FROM '{out}/*.parquet'")
        cols = ", ".join(sorted(r[0] for r in db.sql("DESCRIBE o").fetchall()))
        assert cols == ", ".join(sorted(r[0] for r in db.sql("DESCRIBE m").fetchall()))
        for a, b in (("o", "m"), ("m", "o")):
            assert db.sql(f"SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b} LIMIT 3").fetchall() == []


def test_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
