import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators.orphans import Parent, Reference, orphan_counts, orphan_references

DAY = 86_400_000_000


def build(spark, parents, children):
    p = spark.createDataFrame(parents, "id double, version bigint, created bigint, deleted bigint, key string")
    c = spark.createDataFrame(children, "record bigint, ref double, t bigint, parent string, salt int")
    return (
        [Parent("p", p, F.col("id"), F.col("version"), F.col("created"), F.col("deleted"))],
        [Reference("p", "c", "ref", c, F.col("ref"), F.col("record"), F.col("t"))],
    )


def brute(parents, children):
    current = {}
    for i, version, created, deleted, _ in parents:
        if i is not None:
            own = (version is not None, version or 0, created is not None, created or 0, deleted is not None, deleted or 0)
            current[i] = max(current.get(i, own), own)
    found = set()
    for record, ref, t, *_ in children:
        if ref is None:
            continue
        life = current.get(ref)
        if life is None:
            cause = "missing"
        elif t is not None and life[2] and t < life[3]:
            cause = "not_yet_created"
        elif t is not None and life[4] and t >= life[5]:
            cause = "already_deleted"
        else:
            continue
        day = None if t is None else datetime.date(1970, 1, 1) + datetime.timedelta(days=t // DAY)
        found.add(("c", "ref", record, None if day is None else str(day - datetime.timedelta(days=day.weekday())), cause))
    return found


@pytest.mark.parametrize("broadcast_keys", [0, 1000])
def test_against_brute_force(spark, broadcast_keys):
    rng = random.Random(1)
    parents = [(float(rng.randint(-3, 40)), v, rng.choice([None, rng.randint(-20, 50) * DAY]), rng.choice([None, None, rng.randint(0, 90) * DAY]), "x") for v in range(60)]
    parents += [(None, 1, 0, 0, "x"), parents[0], (99.0, None, 5 * DAY, None, "x")]
    # a third of all records refer to one key, which is deleted half-way
    parents.append((7.0, 1000, 0, 30 * DAY, "x"))
    children = [(k, 7.0 if k % 3 == 0 else rng.choice([None, float(rng.randint(-3, 60)), 99.0, 12.5]), rng.choice([None, rng.randint(-30, 90) * DAY + rng.randint(0, DAY - 1)]), "p", 1) for k in range(900)]
    children += children[:50] + [(None, 1234.0, DAY, "p", 1)]
    orphans = orphan_references(*build(spark, parents, children), broadcast_keys=broadcast_keys)
    got = [(r["ref_table"], r["ref_field"], r["record_id"], r["period"], r["cause"]) for r in orphans.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(parents, children)
    counts = {(r["period"], r["cause"]): r["n_orphans"] for r in orphan_counts(orphans).collect()}
    assert sum(counts.values()) == len(got)


def test_edges(spark):
    life = [(1.0, 1, 10, 20, "x")]
    at = {t: [r["cause"] for r in orphan_references(*build(spark, life, [(1, 1.0, t, "p", 0)])).collect()] for t in (9, 10, 19, 20)}
    assert at == {9: ["not_yet_created"], 10: [], 19: [], 20: ["already_deleted"]}
    assert [r["cause"] for r in orphan_references(*build(spark, life, [(1, float("nan"), 15, "p", 0)])).collect()] == ["missing"]
    assert orphan_references(*build(spark, life, [])).count() == 0
    assert [r["period"] for r in orphan_references(*build(spark, [], [(1, 1.0, -1, "p", 0)])).collect()] == ["1969-12-29"]


def test_two_fields_in_one_scan_and_rows_without_time(spark):
    p = spark.createDataFrame([(1.0, 1, 0, None), (2.0, 1, 50, None)], "id double, version bigint, created bigint, deleted bigint")
    # the rows have columns named like the operator's own
    c = spark.createDataFrame([(1, 1.0, 9.0, 10), (2, 2.0, 1.0, 10), (3, 8.0, 8.0, None), (4, None, None, 10)], "record bigint, key double, parent double, t bigint")
    parents = [Parent(n, p, F.col("id"), F.col("version"), F.col("created"), F.col("deleted")) for n in "pq"]
    record, time = F.col("record"), F.col("t")
    for timed, more in ((True, set()), (False, {("a", 3, "missing"), ("b", 3, "missing")})):
        refs = [Reference("p", "c", "a", c, F.col("key"), record, time, timed), Reference("q", "c", "b", c, F.col("parent"), record, time, timed)]
        for limit in (0, 1, 100):
            got = {(r["ref_field"], r["record_id"], r["cause"]) for r in orphan_references(parents, refs, broadcast_keys=limit).collect()}
            assert got == {("b", 1, "missing"), ("a", 2, "not_yet_created")} | more
    plan = orphan_references(parents, refs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ExistingRDD") == 1  # the children are read once for both fields


def test_only_the_keys_counted_for_it_are_broadcast(spark):
    children = [(k, 7.0 if k % 2 else float(k), DAY, "p", 1) for k in range(400)]
    # 201 broken keys, of which 7.0 has half of the records; the others' files are far below Spark's threshold
    orphans = orphan_references(*build(spark, [(-1.0, 1, 0, None, "x")], children), broadcast_keys=100)
    assert len(orphans.collect()) == 400
    final = orphans._jdf.queryExecution().executedPlan().finalPhysicalPlan().toString()
    assert final.count("SortMergeJoin") == 1 and final.count("BroadcastHashJoin") == 1
