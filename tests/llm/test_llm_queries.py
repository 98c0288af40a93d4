"""The queries with SQL equal their SQL over the smallest tables; the others run."""

import os

import pytest

from gacetilla.llm import queries as Q, sql

FOLDER = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
COLUMNS = {"p1_found": {"grupo_id", "campo", "id"}, "p2_found": {"card_id"}, "p3_found": {"id", "line_no"}, "p4_found": {"id", "tema_id"}, "p5_found": {"id", "line_no"}, "p6_found": {"id", "seccion_id"}, "p7_found": {"id_a", "id_b"}, "p9_found": {"doc_id", "item_id"}, "p10_found": {"doc_id"}}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", list(Q.queries()))
def test_query(spark, name, tmp_path):
    out = f"{tmp_path}/{name}"
    df = Q.queries()[name](spark, FOLDER)
    assert set(df.columns) == COLUMNS.get(name, set(df.columns))
    df.write.parquet(out)
    rows = spark.read.parquet(out)
    if name in COLUMNS:
        assert rows.count() == rows.distinct().count()
    if name in sql.oracle_sql():
        c = duckdb.connect()
        for p in os.listdir(FOLDER):
            c.sql(f"CREATE VIEW {p.split('.')[0]} AS SELECT * FROM '{FOLDER}/{p}'")
        c.sql(f"CREATE TABLE o AS {sql.oracle_sql()[name]}")
        c.sql(f"CREATE TABLE m AS SELECT * FROM '{out}/*.parquet'")
        cols = ", ".join(sorted(r[0] for r in c.sql("DESCRIBE o").fetchall()))
        for a, b in (("o", "m"), ("m", "o")):
            assert c.sql(f"SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b} LIMIT 3").fetchall() == []
