"""Answering a query for many moments of a stream in one job.

A windowed query is a plain query over all records that have arrived in the current window so far. It is
due after every record, or with EVERY at every tick. Each such moment is a snapshot: a position in the
order of arrival and its window. All snapshots of a micro-batch are answered together: each stream
relation is the records of the snapshot's window up to its position, tagged with the snapshot, and the
lowering carries the tag through joins, grouping, DISTINCT and LIMIT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.plans.dialect import Select
from tidewell.plans.lowering import MARK, SNAPSHOT, WIN, NotByRecord, Relation, lower
from tidewell.sources.jsonfile import read_objects

#: Microseconds from year 1, in which windows are counted, to 1970.
YEAR_ONE_US = -62_135_596_800_000_000
SCHEMA = T.StructType(
    [T.StructField("src", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("arrival_us", T.LongType()), T.StructField("value", T.StringType())]
)


def window_start(us: int, width_us: int) -> int:
    """The start of the tumbling window of a moment; windows are multiples of their width since year 1."""
    shift = YEAR_ONE_US % width_us
    return (us - shift) // width_us * width_us + shift


def window_column(us: Column, width_us: int) -> Column:
    shift = YEAR_ONE_US % width_us
    return us - F.pmod(us - F.lit(shift), F.lit(width_us))


def snapshots_of(marks: DataFrame, first_seen: DataFrame, streams: list[str]) -> DataFrame:
    """The snapshots at which every stream of the query has had a record in the window; before that there is no table to query."""
    for k, name in enumerate(streams):
        first = first_seen.where(F.col("src") == name).select("win", F.col("first").alias(f"first{k}"))
        marks = marks.join(first, "win").where(F.col(f"first{k}") <= F.col("at")).drop(f"first{k}")
    return marks


def answer(
    spark: SparkSession, statement: Select, streams: dict[str, DataFrame], statics: dict[str, DataFrame], marks: DataFrame,
    first_mark: Callable[[Column], Column] | None = None, same_window: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """The query's rows for each snapshot, under the hidden column ``SNAPSHOT``, in order of snapshots.

    Streams have the columns ``win`` and ``at`` (window and position) beside their own; ``marks`` has ``win``,
    ``at`` and ``SNAPSHOT``, which equals ``at``. ``first_mark`` gives the position of the first snapshot that has a record, and
    ``same_window`` the window of that position, if it may lie beyond the record's.

    With ``first_mark``, joins and filters are done once for all snapshots, and aggregates with mergeable states run on from
    snapshot to snapshot, so the work is the records plus the answer. Otherwise (outer joins that wait for a record) each
    stream is spread over the snapshots first, which with EVERY is ticks times records of a window.
    """
    used = {t.name.lower() for t in statement.tables()}
    named = [n for n in streams if n.lower() in used]
    seen = None
    for name in named:
        first = streams[name].groupBy("win").agg(F.min("at").alias("first")).select(F.lit(name).alias("src"), "win", "first")
        seen = first if seen is None else seen.unionByName(first)
    snapshots = snapshots_of(marks, seen, named) if named else marks
    relations = {n: Relation(f) for n, f in statics.items() if n.lower() in used}
    if first_mark is not None and named:
        marked = {}
        for name in named:
            rows = streams[name].withColumn(MARK, first_mark(F.col("at"))).withColumnRenamed("win", WIN).drop("at")
            marked[name] = Relation(rows.where(same_window(F.col(MARK)) == F.col(WIN)) if same_window else rows, stream=True)
        try:
            return lower(spark, statement, relations | marked, snapshots, running=True)
        except NotByRecord:
            pass
    own = snapshots.select(SNAPSHOT, F.col("win").alias("__win"), F.col("at").alias("__at"))
    for name in named:
        rows = streams[name]
        expanded = rows.join(own, (rows["win"] == F.col("__win")) & (rows["at"] <= F.col("__at"))).drop("win", "at", "__win", "__at")
        relations[name] = Relation(expanded, stream=True)
    return lower(spark, statement, relations, snapshots)


def stream_frames(buffer: DataFrame, schemas: dict[str, tuple[T.StructType, T.StructType]]) -> dict[str, DataFrame]:
    """The records of each stream as flat columns, from a buffer of ``src``, ``seq``, ``win`` and JSON text ``value``."""
    frames = {}
    for name, (inferred, flat) in schemas.items():
        rows = buffer.where(F.col("src") == name)
        kept = rows.select("win", F.col("seq").alias("at"), "value")
        frames[name] = read_objects(kept, inferred, flat, keep=("win", "at"))
    return frames


def ticks(spark: SparkSession, first_us: int, last_us: int, every_us: int, width_us: int) -> DataFrame:
    """Marks at every tick from the start of the stream, and one at its end, by time."""
    marks = spark.range(1).select(F.explode(F.sequence(F.lit(first_us + every_us), F.lit(max(last_us, first_us + every_us)), F.lit(every_us))).alias("at"))
    marks = marks.where(F.col("at") < last_us).unionByName(spark.range(1).select(F.lit(last_us).cast("bigint").alias("at")))
    return marks.select(window_column(F.col("at"), width_us).alias("win"), "at", F.col("at").alias(SNAPSHOT))


def replay(
    spark: SparkSession, statement: Select, streams: dict[str, DataFrame], statics: dict[str, DataFrame], arrival_us: str = "arrival_us", seq: str = "seq",
    first_us: int | None = None, last_us: int | None = None,
) -> DataFrame:
    """A windowed query over recorded streams, with their own times of arrival as the clock.

    Each stream has the columns ``arrival_us`` and ``seq`` (one order over all streams) beside its records. Without EVERY
    there is one snapshot for each record of any stream, numbered by ``seq``; with EVERY one for each tick between
    ``first_us`` and ``last_us`` (the recorded span if they aren't given) and one at the end, numbered by their time.
    """
    width = statement.over_us
    if not width or width <= 0:
        raise ValueError("a replay needs OVER with a positive duration")
    place = seq if statement.every_us is None else arrival_us
    marked = {
        n: f.withColumn("win", window_column(F.col(arrival_us), width)).withColumn("at", F.col(place)).drop(arrival_us, *([seq] if seq != arrival_us else []))
        for n, f in streams.items()
    }
    first_mark, same_window = (lambda at: at), None
    if statement.every_us is None:
        marks = None
        for f in marked.values():
            own = f.select("win", "at", F.col("at").alias(SNAPSHOT))
            marks = own if marks is None else marks.unionByName(own)
    else:
        if first_us is None or last_us is None:
            spans = [f.agg(F.min(arrival_us), F.max(arrival_us)).first() for f in streams.values()]
            first_us = min((s[0] for s in spans if s[0] is not None), default=0)
            last_us = max((s[1] for s in spans if s[1] is not None), default=0)
        every = statement.every_us
        marks = ticks(spark, first_us, last_us, every, width)

        def first_mark(at: Column) -> Column:
            steps = F.greatest(F.call_function("div", at - F.lit(first_us - every + 1), F.lit(every)), F.lit(1).cast("bigint"))
            return F.least(F.lit(first_us) + steps * F.lit(every), F.lit(last_us).cast("bigint"))

        def same_window(mark: Column) -> Column:
            return window_column(mark, width)

    return answer(spark, statement, marked, statics, marks, first_mark, same_window)
