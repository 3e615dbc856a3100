"""Live streams: arrival is stamped on the driver, records are spooled, micro-batches are answered."""

from __future__ import annotations

import json
import queue
import sys
import threading
import time
from collections.abc import Callable, Iterable
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.scalar import json_text
from tidewell.plans.dialect import Select
from tidewell.plans.lowering import SNAPSHOT
from tidewell.runtime import remove_path, scratch_path
from tidewell.sink import row_text
from tidewell.sources.jsonfile import infer, union_schema
from tidewell.sources.stdin import write_text
from tidewell.streaming.requery import SCHEMA, answer, stream_frames, window_column, window_start

Clock = Callable[[], int]


def system_clock() -> int:
    return time.time_ns() // 1000


class Spool:
    """A folder of small JSON-lines files, each moved into place whole. Rows without ``src`` are ticks."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.seq, self.files, self.held = 0, 0, []
        spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(
            spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        )

    def add(self, src: str | None, arrival_us: int, record: dict | None) -> None:
        self.seq += 1
        self.held.append({"src": src, "seq": self.seq, "arrival_us": arrival_us, "value": None if record is None else json_text(record)})

    def flush(self) -> None:
        if self.held:
            write_text(self.spark, f"{self.path}/spool-{self.files:08d}.json", "".join(json.dumps(r) + "\n" for r in self.held))
            self.files, self.held = self.files + 1, []


class Window:
    """What a windowed query keeps between micro-batches: the raw records of the newest two windows, and the columns seen.

    Records lie in one folder for each micro-batch, so a batch that is run again overwrites its own.
    """

    def __init__(self, spark: SparkSession, statement: Select, streams: list[str], statics: dict[str, DataFrame], path: str):
        self.spark, self.statement, self.streams, self.statics, self.path = spark, statement, streams, statics, path
        self.newest: dict[int, int] = {}
        self.inferred: dict[str, T.StructType] = {}
        self.flat: dict[str, T.StructType] = {}

    def _folder(self, batch: int) -> str:
        return f"{self.path}/batch-{batch:08d}"

    def results(self, rows: DataFrame, batch: int) -> DataFrame | None:
        """The answers for all snapshots of a micro-batch, or None if it holds none."""
        width = self.statement.over_us
        rows = rows.withColumn("win", window_column(F.col("arrival_us"), width))
        rows.write.mode("overwrite").parquet(self._folder(batch))
        stored = self.spark.read.schema(rows.schema).parquet(self._folder(batch))
        span = stored.agg(F.max("win")).first()[0]
        if span is None:
            return None
        self.newest[batch] = span
        self._forget(span - width)
        for name in self.streams:
            fresh = infer(self.spark, stored.where(F.col("src") == name))
            self.flat[name] = union_schema(fresh, self.flat.get(name))
            known = {f.name: f for f in (self.inferred[name].fields if name in self.inferred else [])}
            self.inferred[name] = T.StructType(list((known | {f.name: f for f in fresh.fields if f.name not in known}).values()))
        due = F.col("src").isNull() if self.statement.every_us is not None else F.col("src").isin(self.streams)
        marks = stored.where(due).select("win", F.col("seq").alias("at"), F.col("seq").alias(SNAPSHOT))
        buffer = self.spark.read.schema(rows.schema).parquet(*map(self._folder, sorted(self.newest)))
        frames = stream_frames(buffer, {n: (self.inferred[n], self.flat[n]) for n in self.streams})
        return answer(self.spark, self.statement, frames, self.statics, marks, first_mark=lambda at: at)

    def _forget(self, oldest: int) -> None:
        for batch in [b for b, newest in self.newest.items() if newest < oldest]:
            remove_path(self.spark, self._folder(batch))
            del self.newest[batch]


def print_results(results: DataFrame, out: TextIO) -> None:
    """Rows in the order of their snapshots, without the snapshot's number."""
    names = [c for c in results.columns if c != SNAPSHOT]
    keep = [i for i, c in enumerate(results.columns) if c != SNAPSHOT]
    for row in results.toLocalIterator():
        out.write(row_text(names, [row[i] for i in keep]) + "\n")
    out.flush()


def run_stream(
    spark: SparkSession, statement: Select, inputs: dict[str, Iterable[dict]], statics: dict[str, DataFrame], out: TextIO = sys.stdout,
    clock: Clock = system_clock, flush_s: float = 0.05,
) -> None:
    """Answer a windowed query over open streams until all of them end, printing JSON lines.

    Every input is read by a thread of its own; a record belongs to the window in which it arrives. Without EVERY the full
    result of the current window follows each record; with EVERY it follows each tick, also when nothing new has come,
    and once more at the end. A window that is over is never printed again. Static tables are read as they are.
    """
    if not inputs:
        raise ValueError("OVER requires at least one streaming source")
    base = scratch_path(spark, "stream")
    spool = Spool(spark, f"{base}/spool")
    window = Window(spark, statement, list(inputs), statics, f"{base}/buffer")

    def process(batch: DataFrame, number: int) -> None:
        results = window.results(batch, number)
        if results is not None:
            print_results(results, out)

    query = (
        spark.readStream.schema(SCHEMA).json(spool.path).writeStream.foreachBatch(process).option("checkpointLocation", f"{base}/checkpoint").start()
    )
    arrivals: queue.Queue = queue.Queue(maxsize=10_000)

    def pull(name: str, records: Iterable[dict]) -> None:
        try:
            for record in records:
                arrivals.put((name, record))
        finally:
            arrivals.put((name, None))

    for name, records in inputs.items():
        threading.Thread(target=pull, args=(name, records), daemon=True).start()
    open_, every = set(inputs), statement.every_us
    next_tick = clock() + every if every else None
    try:
        while open_:
            now = clock()
            wait = flush_s if next_tick is None else max(0.0, min(flush_s, (next_tick - now) / 1e6))
            try:
                name, record = arrivals.get(timeout=wait)
                if record is None:
                    open_.discard(name)
                elif record:  # an empty record makes no row
                    spool.add(name, clock(), record)
            except queue.Empty:
                spool.flush()
            if len(spool.held) >= 1_000:
                spool.flush()
            if next_tick is not None and clock() >= next_tick:
                spool.add(None, clock(), None)
                next_tick += every
            if query.exception() is not None:
                raise query.exception()
        if every:
            spool.add(None, clock(), None)
        spool.flush()
        query.processAllAvailable()
    finally:
        query.stop()
        remove_path(spark, base)


__all__ = ["Spool", "Window", "print_results", "run_stream", "system_clock", "window_start"]
