"""Sessions parted by inactivity, from occupancy bitmaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots of one bitmap word.
WORD = 64
SCHEMA = "entity bigint, session_start_ms bigint, session_end_ms bigint, duration_ms bigint, n_events bigint"


def _carry_up(words: np.ndarray, shift: int, follows: np.ndarray) -> np.ndarray:
    """Bits moved ``shift`` slots later; ``follows[i]``: word i is the one right after word i - 1."""
    up = words << np.uint64(shift)
    over = words >> np.uint64(WORD - shift)
    up[1:] |= np.where(follows[1:], over[:-1], np.uint64(0))
    return up


def _carry_down(words: np.ndarray, shift: int, follows: np.ndarray) -> np.ndarray:
    """Bits moved ``shift`` slots earlier."""
    down = words >> np.uint64(shift)
    over = words << np.uint64(WORD - shift)
    down[:-1] |= np.where(follows[1:], over[1:], np.uint64(0))
    return down


def _doubling(words: np.ndarray, reach: int, move, join, follows: np.ndarray) -> np.ndarray:
    """Join a bitmap with its copies moved by 1 .. ``reach`` slots, in log2(reach) shifts."""
    done = 0
    while done < reach:
        step = min(done + 1, reach - done)
        words = join(words, move(words, step, follows))
        done += step
    return words


def close_gaps(words: np.ndarray, follows: np.ndarray, reach: int) -> np.ndarray:
    """Morphological closing by ``reach`` slots: holes of at most ``reach`` empty slots are filled.

    Dilation and erosion both go by doubling shifts. Words must be such that the dilation has room:
    a word that isn't followed by its neighbour loses nothing only if a zero word stands there, so
    callers give every stretch of words a spare zero word at its end.
    """
    wide = _doubling(words, reach, _carry_up, np.bitwise_or, follows)
    return _doubling(wide, reach, _carry_down, np.bitwise_and, follows) | words


def _run_starts(entity: np.ndarray, slot: np.ndarray, reach: int) -> np.ndarray:
    """For rows ordered by entity and slot (distinct): whether the row's slot starts a run of the closed bitmap."""
    word = slot // WORD
    fresh = np.ones(len(slot), bool)
    fresh[1:] = (entity[1:] != entity[:-1]) | (word[1:] != word[:-1])
    at = np.flatnonzero(fresh)
    bits = np.bitwise_or.reduceat(np.uint64(1) << (slot % WORD).astype(np.uint64), at)
    w_entity, w_index = entity[at], word[at]
    next_to = np.zeros(len(at), bool)
    next_to[1:] = (w_entity[1:] == w_entity[:-1]) & (w_index[1:] == w_index[:-1] + 1)
    # a spare zero word after each stretch that isn't continued by the next word
    spare = ~np.append(next_to[1:], False)
    place = np.arange(len(at)) + np.append(0, np.cumsum(spare)[:-1])
    words = np.zeros(len(at) + int(spare.sum()), np.uint64)
    words[place] = bits
    follows = np.zeros(len(words), bool)
    follows[place] = next_to
    follows[place[spare] + 1] = True
    closed = close_gaps(words, follows, reach)
    starts = closed & ~_carry_up(closed, 1, follows)
    own = place[np.cumsum(fresh) - 1]
    # stretches are parted by at least one empty word, which is wider than reach, so none are joined across
    begun = (starts[own] >> (slot % WORD).astype(np.uint64)) & np.uint64(1)
    return begun == 1


def sessions_of_slots(batches: Iterator[pd.DataFrame], gap_ms: int, slots_per_gap: int) -> Iterator[pd.DataFrame]:
    """Sessions of slot rows ordered by entity and slot; only the last open session passes from batch to batch.

    Two occupied slots less than ``slots_per_gap`` apart are surely within the gap, two that are more
    than that apart surely aren't; only at exactly that distance the endpoints decide.
    """
    held: pd.DataFrame | None = None
    start_held, count_held = 0, 0
    for batch in batches:
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        if not len(batch):
            continue
        entity, slot = batch["entity"].to_numpy(np.int64), batch["slot"].to_numpy(np.int64)
        first, last = batch["first_ms"].to_numpy(np.int64), batch["last_ms"].to_numpy(np.int64).copy()
        count = batch["n"].to_numpy(np.int64).copy()
        begins = _run_starts(entity, slot, slots_per_gap - 2) if slots_per_gap > 1 else np.ones(len(slot), bool)
        begins[0] = True
        near = np.zeros(len(slot), bool)
        near[1:] = begins[1:] & (entity[1:] == entity[:-1]) & (slot[1:] - slot[:-1] <= slots_per_gap)
        near[1:] &= first[1:] - last[:-1] <= gap_ms
        at = np.flatnonzero(begins & ~near)
        start = first[at].copy()
        if held is not None:
            start[0], count[0] = start_held, count_held
        total = np.add.reduceat(count, at)
        end = last[np.append(at[1:], len(slot)) - 1]
        held, start_held, count_held = batch.iloc[-1:], int(start[-1]), int(total[-1])
        if len(at) > 1:
            yield pd.DataFrame(
                {"entity": entity[at][:-1], "session_start_ms": start[:-1], "session_end_ms": end[:-1], "duration_ms": (end - start)[:-1], "n_events": total[:-1]}
            )
    if held is not None:
        end = int(held["last_ms"].iloc[0])
        yield pd.DataFrame(
            {"entity": held["entity"].to_numpy(np.int64), "session_start_ms": [start_held], "session_end_ms": [end], "duration_ms": [end - start_held], "n_events": [count_held]}
        )


def sessions(
    events: DataFrame, entity: Column, event_id: Column, time_ms: Column, gap_ms: int = 30 * 60 * 1000, slots_per_gap: int = 30
) -> DataFrame:
    """Split each entity's events into sessions; a new one starts after more than ``gap_ms`` without an event.

    Columns: ``entity``, ``session_start_ms``, ``session_end_ms``, ``duration_ms``, ``n_events``
    (distinct event ids). Rows with a null entity, event id or time belong to no session. Repeated
    deliveries of an event count once (with the least of their entities and times, should they differ). Events
    at one instant are one point in time. An empty table gives no rows.

    Each entity has a bitmap of the slots (``gap_ms / slots_per_gap`` wide) in which it has events,
    stored as words for the stretches that hold any. Closing the bitmap joins all slots that are
    surely within the gap; runs of the closed bitmap are the sessions, after the endpoints of runs
    at the one undecided distance have been compared to the millisecond.

    Skew: an event id is shuffled by itself, and an entity's events are folded into slots map-side
    before they meet. What meets in one task is at most one row for each slot of the time range,
    however many events a hot entity has. Carried from batch to batch is one open session.
    """
    if gap_ms % slots_per_gap or not 1 <= slots_per_gap < WORD:
        raise ValueError("gap_ms must be a multiple of slots_per_gap, which must be below 64")
    width = gap_ms // slots_per_gap
    rows = events.select(entity.alias("entity"), event_id.alias("id"), time_ms.alias("ms")).where(F.col("entity").isNotNull() & F.col("id").isNotNull())
    # null times go after the grouping: a filter before it would work them out twice
    once = rows.groupBy("id").agg(F.min("entity").alias("entity"), F.min("ms").alias("ms")).where(F.col("ms").isNotNull())
    slots = (
        once.groupBy("entity", F.floor(F.col("ms") / F.lit(width)).alias("slot"))
        .agg(F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"), F.count(F.lit(1)).alias("n"))
    )
    ordered = slots.repartition("entity").sortWithinPartitions("entity", "slot")
    return ordered.mapInPandas(lambda batches: sessions_of_slots(batches, gap_ms, slots_per_gap), SCHEMA)
