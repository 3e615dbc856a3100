import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators.features import FeatureTable, feature_column, feature_rows, normal_type, wide
from tidewell.runtime import scratch_path

SCHEMA = "event_id bigint, entity bigint, type string, us bigint, amount double, cells int"


def make(n, seed=1):
    rng = random.Random(seed)
    rows = [(k, 1 if k % 3 == 0 else rng.randint(2, 40), rng.choice("abcdefgh"), rng.randint(0, 10**9), rng.choice([None, 1.5, -2.0]), 0) for k in range(n)]
    return rows + rows[: n // 10]


def brute(rows):
    cells = {}
    for _, entity, kind, us, amount, _ in {r[0]: r for r in rows}.values():
        n, last, total = cells.get((entity, kind), (0, -1, 0.0))
        cells[entity, kind] = (n + 1, max(last, us), total + (amount or 0.0))
    return cells


def flat(frame):
    return {(r["entity"], k): (c["n"], c["last_us"], c["total"]) for r in frame.collect() for k, c in r["cells"].items()}


def prepare(stream):
    return stream.select("event_id", "entity", "type", "us", "amount")


@pytest.mark.parametrize("files,per_batch", [(1, 1 << 30), (4, 1)])
def test_stream_equals_brute_force(spark, tmp_path, files, per_batch):
    rows = make(600)
    spark.createDataFrame(rows, SCHEMA).repartition(files, "type").write.parquet(str(tmp_path / "events.parquet"))
    got = feature_rows(spark, str(tmp_path / "events.parquet"), prepare, bytes_per_batch=per_batch)
    assert flat(got) == brute(rows)
    assert got.count() == len({r[1] for r in rows})


CELLS = "entity bigint, type string, n bigint, last_us bigint, total double"


def test_rerun_batches_count_once_and_old_versions_go(spark):
    table = FeatureTable(spark, scratch_path(spark, "table"), buckets=4)
    for batch in range(9):
        changed = spark.createDataFrame([(batch % 4, f"t{batch}", batch + 1, batch, 1.0), (9, "x", batch + 1, batch, 2.0)], CELLS)
        table.upsert(changed, batch)
        table.upsert(changed, batch)
    got = flat(table.current())
    assert got[9, "x"] == (9, 8, 2.0) and got[0, "t8"] == (9, 8, 1.0) and got[0, "t0"] == (1, 0, 1.0) and len(got) == 10
    assert max(map(len, table.versions.values())) == 2


def test_only_touched_buckets_are_written(spark):
    table = FeatureTable(spark, scratch_path(spark, "table"), buckets=16)
    table.upsert(spark.createDataFrame([(k, "a", 1, 5, 1.0) for k in range(200)], CELLS), 0)
    table.upsert(spark.createDataFrame([(7, "b", 2, 6, 1.0), (1000, "b", 1, 1, 0.0)], CELLS), 1)
    assert len(table.versions) == 16 and sum(own == [0, 1] for own in table.versions.values()) <= 2
    got = flat(table.current())
    assert len(got) == 202 and got[7, "a"] == (1, 5, 1.0) and got[7, "b"] == (2, 6, 1.0)


def test_empty_input_and_wide_columns(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none.parquet"))
    assert feature_rows(spark, str(tmp_path / "none.parquet"), prepare).count() == 0
    spark.createDataFrame([(1, 5, "buy", 3_000_000, 2.5, 0)], SCHEMA).write.parquet(str(tmp_path / "one.parquet"))
    rows = feature_rows(spark, str(tmp_path / "one.parquet"), prepare)
    assert [tuple(r) for r in wide(rows, ["buy", "sell"], F.lit(10_000_000)).collect()] == [(5, 1, 7.0, 2.5, 0, None, 0.0)]
    assert set(feature_column(F.col("cells"), "buy", F.lit(1))) == {"n", "since_s", "total"}


def test_types_are_compared_bare(spark):
    frame = spark.createDataFrame([(" \tLog In ",), ("  ",), ("",), (None,), ("a\n",)], "x string")
    assert [r[0] for r in frame.select(normal_type(F.col("x"))).collect()] == ["log in", None, None, None, "a\n"]


def test_a_stopped_stream_is_carried_on(spark, tmp_path):
    rows, events, state = make(600), str(tmp_path / "events.parquet"), f"file://{tmp_path}/state"
    for begin, end in ((0, 200), (200, 400), (400, len(rows))):
        spark.createDataFrame(rows[begin:end], SCHEMA).repartition(6, "type").write.mode("append").parquet(events)
        got = flat(feature_rows(spark, events, prepare, bytes_per_batch=1, state=state))
        assert got == brute(rows[:end])
    assert flat(feature_rows(spark, events, prepare, state=state)) == brute(rows)  # nothing new


def test_an_opened_table_has_what_is_complete(spark):
    path = scratch_path(spark, "table")
    for batch in range(9):  # another table each time, as after a lost driver
        table = FeatureTable(spark, path, buckets=4 + batch)
        table.upsert(spark.createDataFrame([(batch % 4, f"t{batch}", batch + 1, batch, 1.0), (9, "x", batch + 1, batch, 2.0)], CELLS), batch)
    kept = flat(table.current())
    assert len(kept) == 10 and kept[9, "x"] == (9, 8, 2.0) and table.buckets == 4
    broken = spark.range(1).selectExpr("9 AS entity", "1 AS bucket").write.partitionBy("bucket")
    broken.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/version-00000009-of-4")
    again = FeatureTable(spark, path)
    assert again.versions == table.versions and flat(again.current()) == kept


def test_nulls_and_odd_paths(spark, tmp_path):
    rows = [(1, 5, "a", 10, None, 0), (None, 5, "a", 11, 1.0, 0), (2, None, "a", 12, 1.0, 0), (3, 5, None, 13, 1.0, 0), (4, 5, "a", None, 1.0, 0), (1, 5, "a", 10, None, 0)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "plain"))
    odd = (tmp_path / "plain").rename(tmp_path / "a[1]{b}*")
    assert flat(feature_rows(spark, str(odd), prepare)) == {(5, "a"): (1, 10, 0.0)}
