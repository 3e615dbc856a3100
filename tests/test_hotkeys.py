from pyspark.sql import functions as F

from tidewell.operators.hotkeys import dominating_keys, per_key_totals
from tidewell.runtime import inexact_keys


def test_dominating_keys(spark):
    rows = [("a", 1)] * 40 + [("a", k) for k in range(2, 32)] + [("a", None)] * 30 + [("b", 5)] * 2 + [("b", k) for k in range(100, 198)]
    found = dominating_keys(spark.createDataFrame(rows, "part string, key bigint"), "part", "key", 0.02)
    # exactly two of a hundred isn't more than two percent
    assert [(r["part"], r["key"], r["n_rows"], r["n_total"]) for r in found.collect()] == [("a", 1, 40, 100)]
    assert dominating_keys(spark.createDataFrame([], "part string, key bigint"), "part", "key", 0.02).count() == 0


def test_totals_and_plan(spark):
    rows = spark.createDataFrame([("a", 1, 2.0), ("a", 1, None), ("a", None, 1.0), ("b", 1, 5.0)], "part string, key bigint, n_rows double")
    totals = per_key_totals(rows, ["part", "key"], {"n": F.count(F.lit(1)), "s": F.sum("n_rows")})
    assert sorted(map(tuple, totals.collect()), key=repr) == sorted([("a", 1, 2, 2.0), ("a", None, 1, 1.0), ("b", 1, 1, 5.0)], key=repr)
    plan = totals._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_count") > plan.index("Exchange")  # states are made before the shuffle


def test_one_aggregate_serves_counts_and_totals(spark):
    rows = spark.range(1000).selectExpr("'a' AS part", "id % 3 AS key")
    found = dominating_keys(rows, "part", "key", 0.3).select("part", "key")
    assert found.count() == 3
    found.collect()
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()


def test_keys_that_are_no_whole_numbers_are_counted(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.5), ("a", None, 2.0**60), ("b", 0.5, None)], "part string, k double, m double")
    assert sorted(map(tuple, inexact_keys(rows, "part", ["k", "m"]).collect())) == [("a", "k", 2, 0), ("a", "m", 2, 2), ("b", "k", 1, 1), ("b", "m", 1, 0)]
