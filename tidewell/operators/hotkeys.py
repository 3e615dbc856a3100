"""Per-key results when a handful of keys hold most records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_key_totals(rows: DataFrame, keys: list[str], aggregates: dict[str, Column]) -> DataFrame:
    """One row for each combination of ``keys``, by algebraic aggregates only.

    Every aggregate given must have a mergeable partial state (count, sum, min, max, avg, bit_or,
    ...). Spark then combines map-side: each input partition folds its rows into a hash table of
    key states that spills when it outgrows memory, and only one compact state per partition and
    key is shuffled. A key with a third of all rows therefore sends as many states as a key with
    one row in each partition, and no reduce task sees its rows.

    Null keys form their own group. An empty input gives no rows. Other columns, whatever their
    names, are pruned.
    """
    return rows.groupBy(*keys).agg(*(column.alias(name) for name, column in aggregates.items()))


def dominating_keys(rows: DataFrame, part: str, key: str, share: float) -> DataFrame:
    """The non-null keys that hold more than ``share`` of all rows of their part, as stored.

    ``part`` parts the input into tables, ``key`` is the key. There are fewer than ``1 / share``
    such keys in a part, at every size. The result has ``part``, ``key``, ``n_rows`` and
    ``n_total``; rows with a null key count towards the total only. The share is strict: a key
    that holds exactly ``share`` is left out. An empty input gives no rows.
    """
    counts = per_key_totals(rows, [part, key], {"n_keyed": F.count(key), "n_rows": F.count(F.lit(1))})  # n_keyed is 0 for the null key
    # both counts are named on either side of the join, so that both sides are one aggregate, which is made once
    totals = per_key_totals(counts, [part], {"n_total": F.sum(F.greatest("n_rows", "n_keyed"))})
    # totals has one row for each part (the number of tables in the union), so it may be broadcast
    return counts.join(F.broadcast(totals), part).where(F.least("n_rows", "n_keyed") > F.lit(share) * F.col("n_total")).drop("n_keyed")
