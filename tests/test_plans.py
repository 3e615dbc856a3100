"""What must reach the scan, stay out of Python and shuffle only states."""

import re

import duckdb
import pytest

from tidewell.plans.dialect_queries import BATCH, QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


def plan(spark, name):
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name,pushed,columns",
    [
        ("filter_time", "GreaterThanOrEqual(l_shipdate", 3), ("filter_cmp", "GreaterThanOrEqual(o_totalprice", 3), ("in_list", "In(p_size", 3), ("between", "LessThanOrEqual(p_size,20)", 2),
        ("is_null", "IsNull(text)", 3), ("orderby_limit_topk", "", 2), ("agg_group", "", 4),
    ],
)
def test_filters_and_columns_reach_the_scan(spark, name, pushed, columns):
    text = spark.sql("SELECT 1")._sc._jvm.PythonSQLUtils.explainString(QUERIES[name](spark, FOLDER)._jdf.queryExecution(), "formatted")
    filters, schema = re.search(r"PushedFilters: \[(.*)\]", text), re.search(r"ReadSchema: struct<(.*)>", text)
    assert pushed in (filters[1] if filters else "")
    assert len(schema[1].split(",")) == columns


def test_topk_needs_no_full_sort(spark):
    assert plan(spark, "orderby_limit_topk").startswith("TakeOrderedAndProject")


@pytest.mark.parametrize("name", [n for n in BATCH if n not in ("fn_date_modifiers",)])
def test_no_python_in_batch_queries(spark, name):
    assert not re.search("Python|Pandas|Arrow", plan(spark, name))


@pytest.mark.parametrize("name", ["text_arith", "fn_date_modifiers"])
def test_expressions_are_computed_for_every_order(spark, name):
    orders = "/root/testdata/sf0.01/orders.parquet"
    frame = QUERIES[name](spark, "/root/testdata/sf0.01")
    got = sorted(map(tuple, frame.collect()))
    assert [k for k, *_ in got] == [k for (k,) in duckdb.sql(f"SELECT o_orderkey FROM '{orders}' ORDER BY 1").fetchall()]
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW orders AS SELECT * FROM '{orders}'")
        assert got == sorted(db.execute(SQL[name]).fetchall())


@pytest.mark.parametrize("name", ["every_ticks", "tumbling_count", "tumbling_weeks", "tumbling_join_static", "per_record_snapshots"])
def test_windowed_aggregates_run_on_from_tick_to_tick(spark, name):
    text = plan(spark, name)
    assert "__at" not in text and "_first" in text and "Window" in text  # records are joined with no snapshot
    assert re.search(r"partial_(count|sum|max)", text)


@pytest.mark.parametrize("name", ["stream_distinct", "stream_stream", "stream_left_static"])
def test_other_windowed_queries_join_before_they_are_shown_by_snapshot(spark, name):
    assert "__at" not in plan(spark, name) and "__mark" in plan(spark, name)
