"""Windowed queries: live runs, and snapshots against re-running the query for every prefix."""

import io
import json
import queue
import threading
import time

import pytest
from fixtures import write_all

from tidewell.engine import Engine, stream
from tidewell.plans.dialect import QueryError, parse_one
from tidewell.plans.lowering import SNAPSHOT
from tidewell.streaming.requery import replay, window_start


def run(engine, query, inputs, **options):
    out = io.StringIO()
    stream(engine, query, inputs, out, **options)
    return [json.loads(line) for line in out.getvalue().splitlines()]


@pytest.fixture(scope="module")
def boats(spark, tmp_path_factory):
    return write_all(tmp_path_factory.mktemp("files"))["boats"]


def test_each_record_prints_the_whole_window(spark, boats):
    signals = [{"boat": b, "kind": k} for b, k in ((12, "depart"), (20, "radio"), (23, "radio"), (20, "arrive"))]
    engine = Engine(spark).add_source("boats", boats)
    query = "SELECT s.kind, b.title FROM signals s JOIN boats b ON s.boat = b.boat {} OVER 24h"
    assert [r["title"] for r in run(engine, query.format(""), {"signals": iter(signals)})].count("Brise") == 4
    assert len(run(engine, query.format(""), {"signals": iter(signals)})) == 1 + 2 + 3 + 4
    assert len(run(engine, query.format("WHERE b.crew > 3"), {"signals": iter(signals)})) == 0 + 1 + 2 + 3


def test_groups_left_join_and_late_columns(spark, boats):
    engine = Engine(spark).add_source("boats", boats)
    got = run(engine, "SELECT kind, COUNT(*) AS n FROM signals GROUP BY kind OVER 24h", {"signals": iter([{"kind": k} for k in ("radio", "alarm", "alarm", "depart", "alarm")])})
    assert len(got) == 1 + 2 + 2 + 3 + 3 and {r["kind"]: r["n"] for r in got[-3:]} == {"radio": 1, "alarm": 3, "depart": 1}
    got = run(engine, "SELECT s.boat, b.title, s.extra FROM signals s LEFT JOIN boats b ON s.boat = b.boat OVER 24h", {"signals": iter([{"boat": 17}, {"boat": 98, "extra": "x"}])})
    assert sorted(map(json.dumps, got)) == sorted(map(json.dumps, [
        {"boat": 17, "extra": None, "title": "Elster"}, {"boat": 17, "extra": None, "title": "Elster"}, {"boat": 98, "extra": "x", "title": None}]))


def test_two_streams_wait_for_each_other(spark):
    calls, replies = queue.Queue(), queue.Queue()

    def feed(q):
        while (r := q.get()) is not None:
            yield r

    out = io.StringIO()
    query = "SELECT c.caller, r.words FROM calls c JOIN replies r ON c.channel = r.channel OVER 24h"
    thread = threading.Thread(target=stream, args=(Engine(spark), query, {"calls": feed(calls), "replies": feed(replies)}, out))
    thread.start()
    calls.put({"channel": 16, "caller": "mole"})
    time.sleep(4)
    assert out.getvalue() == ""
    replies.put({"channel": 16, "words": "aye"})
    deadline = time.time() + 30
    while "aye" not in out.getvalue() and time.time() < deadline:
        time.sleep(0.1)
    assert json.loads(out.getvalue().splitlines()[0]) == {"caller": "mole", "words": "aye"}  # while both are still open
    calls.put(None), replies.put(None)
    thread.join(60)
    assert not thread.is_alive()


def test_every_prints_also_when_idle(spark):
    def slow():
        for x in range(3):
            yield {"x": x}
            time.sleep(0.8)

    got = [r["n"] for r in run(Engine(spark), "SELECT COUNT(*) AS n FROM data OVER 24h EVERY 300ms", {"data": slow()})]
    assert got == sorted(got) and got[-1] == 3 and len(got) >= 5


def test_window_roll_over_with_a_set_clock(spark):
    now = [1_000_000_000_000_000]

    def clock():
        return now[0]

    def records():
        for k in range(4):
            yield {"k": k}
            time.sleep(0.3)
            now[0] += 40_000_000  # the window of a minute is over after two records at most

    got = run(Engine(spark), "SELECT COUNT(*) AS n FROM s OVER 1m", {"s": records()}, clock=clock)
    starts = [window_start(1_000_000_000_000_000 + 40_000_000 * k, 60_000_000) for k in range(4)]
    assert [r["n"] for r in got] == [sum(s == starts[k] for s in starts[: k + 1]) for k in range(4)]


def test_needs_a_stream(spark, boats):
    with pytest.raises(QueryError, match="at least one streaming source"):
        stream(Engine(spark).add_source("boats", boats), "SELECT * FROM boats OVER 1m", {}, io.StringIO())


def test_windows_count_from_year_one():
    minute, week = 60_000_000, 7 * 86_400_000_000
    assert window_start(61_000_000, minute) == minute
    assert window_start(0, week) == -3 * 86_400_000_000  # 1970-01-01 was a Thursday, windows of a week begin on Monday
    assert window_start(0, 7 * minute) % (7 * minute) == 360_000_000


PREFIX = [
    "SELECT a.k, b.v FROM a LEFT JOIN b ON a.k = b.k",
    "SELECT b.k, a.v FROM a RIGHT JOIN b ON a.k = b.k",
    "SELECT DISTINCT a.k FROM a",
    "SELECT a.k, SUM(a.v) AS s FROM a GROUP BY a.k ORDER BY s DESC LIMIT 2",
    "SELECT COUNT(*) AS n, MAX(v) AS m FROM a WHERE v > 5",
    "SELECT a.k, t.name FROM a JOIN t ON a.k = t.k",
    "SELECT t.name, a.v FROM t LEFT JOIN a ON a.k = t.k",
    "SELECT t.name, a.v FROM a RIGHT JOIN t ON a.k = t.k",
    "SELECT a.v FROM a ORDER BY a.v LIMIT 1",
    "SELECT k % 2 AS odd, AVG(v) AS m, MIN(v) AS lo, TOTAL(k) AS t, COUNT(v) AS c FROM a GROUP BY odd ORDER BY odd",
    "SELECT COUNT(*) AS n, SUM(v) AS s, AVG(k) AS m FROM a WHERE v > 100",
    "SELECT t.name, COUNT(*) AS n, MAX(a.v) AS m FROM a LEFT JOIN t ON a.k = t.k GROUP BY t.name",
    "SELECT t.name, COUNT(a.v) AS n FROM t LEFT JOIN a ON a.k = t.k GROUP BY t.name",
    "SELECT a.k, GROUP_CONCAT(a.v) AS g FROM a GROUP BY a.k",
    "SELECT a.k, a.v, MAX(a.v) AS m FROM a GROUP BY a.k",
    "SELECT a.k FROM a GROUP BY a.k",
    "SELECT x.v, y.v AS w FROM a x JOIN a y ON x.k = y.k AND x.v < y.v",
    "SELECT a.v, b.v AS w, t.name FROM a JOIN b ON a.k = b.k LEFT JOIN t ON t.k = b.k WHERE a.v + b.v > 12",
    "SELECT a.k, SUM(b.v) AS s FROM a JOIN b ON a.k = b.k GROUP BY a.k",
]


@pytest.mark.parametrize("query", PREFIX)
def test_snapshots_equal_prefix_queries(spark, query):
    records = [("a", 1, 3), ("b", 1, 10), ("a", 2, 7), ("a", 1, 9), ("b", 3, 11), ("a", 3, 1), ("b", 1, 12), ("a", 4, 8)]
    minute = 60_000_000
    placed = [(src, k, v, n, n * 25_000_000) for n, (src, k, v) in enumerate(records, 1)]
    frames = {s: spark.createDataFrame([(k, v, n, at) for src, k, v, n, at in placed if src == s], "k bigint, v bigint, seq bigint, arrival_us bigint") for s in "ab"}
    static = spark.createDataFrame([(1, "one"), (2, "two"), (9, "nine")], "k bigint, name string")
    statement = parse_one(query + " OVER 1m")
    streams = {n: f for n, f in frames.items() if n in {t.name for t in statement.tables()}}
    got = {}
    for row in replay(spark, statement, streams, {"t": static}).collect():
        values = row.asDict()
        got.setdefault(values.pop(SNAPSHOT), []).append(values)
    for src, _, _, n, at in placed:
        if src not in streams:
            continue
        window = window_start(at, minute)
        seen = [p for p in placed if p[3] <= n and window_start(p[4], minute) == window]
        if {s for s in streams} - {p[0] for p in seen}:
            assert n not in got
            continue
        engine = Engine(spark).add_frame("t", static)
        for s in streams:
            engine.add_frame(s, spark.createDataFrame([(k, v) for src2, k, v, _, _ in seen if src2 == s], "k bigint, v bigint"))
        expected = [r.asDict() for r in engine.sql(query).collect()]
        assert sorted(map(repr, got.get(n, []))) == sorted(map(repr, expected)), (n, query)
