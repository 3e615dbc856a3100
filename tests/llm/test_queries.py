"""The package's queries over the smallest tables."""

import pytest

from tidewell.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs_over_whole_tables(spark, name):
    frame = QUERIES[name](spark, FOLDER)
    n = frame.count()
    assert n > 0 and frame.columns
    if name == "p6_ids":
        assert n == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for table in ("documents", "eval_items"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    assert sorted(map(tuple, QUERIES[name](spark, FOLDER).collect())) == sorted(db.execute(SQL[name]).fetchall())
