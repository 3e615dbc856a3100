import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.operators.sessions import close_gaps, sessions, sessions_of_slots

GAP = 1_800_000


def brute(events, gap):
    by = {}
    for i, user, ms in events:
        if None not in (i, user, ms):
            by.setdefault(user, {})[i] = min(ms, by.get(user, {}).get(i, ms))
    found = []
    for user, own in by.items():
        times = sorted(own.values())
        start = n = 0
        for k, t in enumerate(times):
            if k and t - times[k - 1] > gap:
                found.append((user, start, times[k - 1], times[k - 1] - start, n))
                n = 0
            if not n:
                start = t
            n += 1
        found.append((user, start, times[-1], times[-1] - start, n))
    return sorted(found)


def run(spark, events, **options):
    frame = spark.createDataFrame(events, "id bigint, user bigint, ms bigint").selectExpr("*", "id AS entity", "1 AS slot", "2 AS n")
    got = sessions(frame, F.col("user"), F.col("id"), F.col("ms"), **options)
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("per_gap", [1, 2, 3, 30, 63 if GAP % 63 == 0 else 60])
def test_random_events(spark, per_gap):
    rng = random.Random(per_gap)
    width = GAP // per_gap
    events, n = [], 0
    for user in range(-2, 12):
        t = rng.randint(-(10**9), 10**9)
        for _ in range(rng.randint(1, 120)):
            t += rng.choice([0, 1, GAP, GAP + 1, GAP - 1, width, width - 1, rng.randint(0, GAP), rng.randint(GAP, 3 * GAP), 70 * width, rng.randint(0, 5000)])
            n += 1
            events.append((n, user, t))
            if rng.random() < 0.1:
                events.append((n, user, t))
    events += [(None, 1, 5), (10**6, None, 5), (10**6 + 1, 1, None)]
    rng.shuffle(events)
    assert run(spark, events, slots_per_gap=per_gap) == brute(events, GAP)


def test_gap_is_exact_and_hot_entity(spark):
    assert run(spark, [(1, 1, 0), (2, 1, GAP)]) == [(1, 0, GAP, GAP, 2)]
    assert run(spark, [(1, 1, 0), (2, 1, GAP + 1)]) == [(1, 0, 0, 0, 1), (1, GAP + 1, GAP + 1, 0, 1)]
    events = [(k, 1, k * 700) for k in range(30_000)] + [(10**6 + k, k, 5) for k in range(2, 500)]
    assert run(spark, events)[0] == (1, 0, 29_999 * 700, 29_999 * 700, 30_000)
    assert run(spark, []) == []


def test_batches_of_any_size_give_the_same():
    rng = random.Random(2)
    rows, slot = [], 0
    for entity in range(5):
        for _ in range(50):
            slot += rng.choice([1, 2, 29, 30, 31, 64, 65, 200])
            first = slot * 60_000 + rng.randint(0, 59_999)
            rows.append((entity, slot, first, rng.randint(first, slot * 60_000 + 59_999), rng.randint(1, 5)))
    frame = pd.DataFrame(rows, columns=["entity", "slot", "first_ms", "last_ms", "n"])
    whole = pd.concat(sessions_of_slots(iter([frame]), GAP, 30), ignore_index=True)
    for size in (1, 2, 7, 64):
        parts = [frame.iloc[k : k + size].reset_index(drop=True) for k in range(0, len(frame), size)]
        assert pd.concat(sessions_of_slots(iter(parts), GAP, 30), ignore_index=True).equals(whole)
    assert int(whole["n_events"].sum()) == int(frame["n"].sum())


def test_closing_fills_holes_up_to_the_reach():
    rng = random.Random(4)
    for reach in (0, 1, 2, 5, 28, 61):
        bits = np.zeros(64 * 6, bool)
        bits[[rng.randrange(64 * 5) for _ in range(12)]] = True
        words = np.array([sum(1 << k for k in range(64) if bits[64 * w + k]) for w in range(6)], np.uint64)
        closed = close_gaps(words, np.array([False] + [True] * 5), reach)
        expected = bits.copy()
        at = np.flatnonzero(bits)
        for a, b in zip(at, at[1:], strict=False):
            if b - a - 1 <= reach:
                expected[a:b] = True
        assert [(int(closed[k // 64]) >> (k % 64)) & 1 for k in range(64 * 6)] == expected.astype(int).tolist()
