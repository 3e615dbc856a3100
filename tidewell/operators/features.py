"""Per-entity feature tables, maintained by a stateful stream."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.runtime import child_names, path_bytes, remove_path, scratch_path

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CELL = "struct<n:bigint,last_us:bigint,total:double>"
#: A run over files that lie there already takes about so many micro-batches, none smaller than so many bytes.
RUN_BATCHES, LEAST_BATCH = 16, 256 << 20


def normal_type(text: Column) -> Column:
    """An event type stripped of spaces and tabs, in lower case; null if nothing is left."""
    bare = F.lower(F.btrim(text, F.lit(" \t")))
    return F.when(bare != "", bare)


def cell_states(events: DataFrame) -> DataFrame:
    """Counter, latest time and total for each entity and type, of rows ``event_id, entity, type, us, amount``.

    A repeated event id counts once, as it came first. Rows with a null among the first four columns don't count. On a
    stream both steps keep their state; the counters are algebraic and combine map-side, so a hot entity sends
    one state per partition and type.
    """
    once = events.where(F.col("event_id").isNotNull() & F.col("entity").isNotNull()).dropDuplicates(["event_id"])
    # asked only here: a filter below the state would be pushed into the scan and work out types and times twice
    known = once.where(F.col("type").isNotNull() & F.col("us").isNotNull())
    return known.groupBy("entity", "type").agg(
        F.count(F.lit(1)).alias("n"), F.max("us").alias("last_us"), F.sum(F.coalesce("amount", F.lit(0.0))).alias("total")
    )


class FeatureTable:
    """Feature rows under one path, in buckets by a hash of the entity.

    Each batch writes one version: the buckets it touches, whole, with the full rows of their entities. A bucket's
    newest version counts, so reading needs no merge, and a batch reads and writes only the buckets that hold
    entities it changed. A batch that is run again after a failure starts from the versions before it and
    overwrites its own, so an upsert happens once; for that a bucket's last but one version stays, older ones are
    dropped. What lies complete under the path when a table is opened is carried on from, with the number of
    buckets it was made with.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.spark, self.path = spark, path
        named = [m for f in child_names(spark, path, "_SUCCESS") if (m := re.fullmatch(r"version-([0-9]{8,})-of-([0-9]+)", f))]
        self.buckets = int(named[0][2]) if named else buckets
        #: The versions that hold each bucket, the newest last.
        self.versions: dict[int, list[int]] = {}
        for version in sorted(int(m[1]) for m in named):
            self._note(version)
        self.schema = f"entity bigint, cells map<string,{CELL}>"

    def _folder(self, version: int, bucket: int | None = None) -> str:
        return f"{self.path}/version-{version:08d}-of-{self.buckets}" + ("" if bucket is None else f"/bucket={bucket}")

    def _held(self, folder: str) -> list[int]:
        return [int(f.removeprefix("bucket=")) for f in child_names(self.spark, folder) if f.startswith("bucket=")]

    def _note(self, version: int) -> None:
        for bucket in self._held(self._folder(version)):
            self.versions[bucket] = sorted({*self.versions.get(bucket, []), version})

    def _newest(self, below: int | None = None) -> dict[int, str]:
        """The folder of each bucket's newest version, of all or of those before ``below``."""
        last = {b: max((v for v in own if below is None or v < below), default=None) for b, own in self.versions.items()}
        return {b: self._folder(v, b) for b, v in last.items() if v is not None}

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def current(self, below: int | None = None) -> DataFrame:
        """The newest full row of each entity, of all batches or of those before ``below``."""
        return self._read(sorted(self._newest(below).values()))

    def _write(self, rows: DataFrame, folder: str) -> None:
        own = rows.withColumn("bucket", F.pmod(F.hash("entity"), F.lit(self.buckets)))
        own.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(folder)

    def upsert(self, changed: DataFrame, batch: int) -> None:
        """Merge changed cells, which hold whole counters rather than increments, into the rows of their entities."""
        fresh = changed.groupBy("entity").agg(
            F.map_from_entries(F.collect_list(F.struct("type", F.struct("n", "last_us", "total").cast(CELL).alias("cell")))).alias("cells")
        )  # an entity has at most as many cells as there are types
        before, delta = self._newest(batch), f"{self.path}/delta-{batch:08d}"
        if before:
            # the changes are written first, as their folders name the buckets and the state is to be asked only once
            self._write(fresh, delta)
            touched = self._held(delta)
            old = self._read([before[b] for b in touched if b in before]).withColumnRenamed("cells", "old")
            none = F.create_map().cast(f"map<string,{CELL}>")
            kept = F.map_filter(F.coalesce("old", none), lambda kind, _: ~F.map_contains_key(F.coalesce("cells", none), kind))
            new = self._read([f"{delta}/bucket={b}" for b in touched])
            fresh = new.join(old, "entity", "full").select("entity", F.map_concat(kept, F.coalesce("cells", none)).alias("cells"))
        self._write(fresh, self._folder(batch))
        if before:
            remove_path(self.spark, delta)
        self._note(batch)
        for bucket, own in self.versions.items():
            for stale in own[:-2]:
                remove_path(self.spark, self._folder(stale, bucket))
            self.versions[bucket] = own[-2:]


def maintain_features(stream: DataFrame, table: FeatureTable, checkpoint: str) -> None:
    """Run a stream of ``event_id, entity, type, us, amount`` to its present end, upserting feature rows after each batch.

    Counters and latest times live in the checkpointed state store, in RocksDB, so they outlive an
    executor and needn't fit a heap.
    """
    spark = stream.sparkSession
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": _ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
        "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
        # a total that nothing asks for would cost a read before each write
        "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
        "spark.sql.streaming.stateStore.compression.codec": "zstd",
        # stores of streams that have ended leave memory soon
        "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
        "spark.sql.streaming.minBatchesToRetain": "2",
    }
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        query = (
            cell_states(stream)
            .writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(lambda changed, batch: table.upsert(changed, batch))
            .start()
        )
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _as_pattern(path: str) -> str:
    """A pattern that only the path itself fits: a stream takes a single file only from a pattern."""
    plain = [k for k, c in enumerate(path) if c.isalnum()]
    return "".join(f"[{c}]" if k == plain[-1] else "\\" + c if c in "*?[]{}\\" else c for k, c in enumerate(path))


def feature_rows(spark: SparkSession, path: str, prepare, bytes_per_batch: int | None = None, state: str | None = None, buckets: int = 32) -> DataFrame:
    """One row for each entity of the Parquet files at ``path``: ``entity`` and ``cells``, a map from type to its counters.

    ``prepare`` turns a frame of the files' rows into ``event_id, entity, type, us, amount``. Rows with a null
    event id, entity, type or time don't count. Types without an event have no entry in ``cells``; read them as
    count 0, total 0 and no last time (``feature_column``). A null amount adds nothing. An empty input gives
    no rows. Repeated event ids count once, across batches too.

    The files are read as a stream, at once, in micro-batches of ``bytes_per_batch``; unless given, these are a
    ``1 / RUN_BATCHES`` of all files, ``LEAST_BATCH`` at least, so that merging a run's batches into the table costs a
    fixed number of passes over it, however large the input is. The checkpoint and the table lie in the
    shared folder; the checkpoint is dropped at the end. With ``state``, a path that all executors share,
    both lie there and stay: a later call with the same ``state`` reads only the files that are new since, or that a
    stopped run left, and gives all rows. It may replace the folders that the rows of an earlier call are read from.
    """
    schema = spark.read.parquet(_as_pattern(path)).schema
    base = state.rstrip("/") if state else scratch_path(spark, "features")
    size = bytes_per_batch or max(LEAST_BATCH, path_bytes(spark, path) // RUN_BATCHES)
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", size).parquet(_as_pattern(path))
    table = FeatureTable(spark, f"{base}/table", buckets)
    maintain_features(prepare(stream), table, f"{base}/checkpoint")
    if not state:
        remove_path(spark, f"{base}/checkpoint")
    return table.current()


def latest_us(rows: DataFrame) -> int | None:
    """The time of the last event of all entities, from which recency may be counted; null without events."""
    return rows.select(F.max(F.array_max(F.transform(F.map_values("cells"), lambda cell: cell["last_us"])))).first()[0]


def with_recency(rows: DataFrame, now_us: int | None) -> DataFrame:
    """The feature rows with ``n``, ``since_s`` (seconds from the last event to ``now_us``) and ``total`` for each type."""
    now = F.lit(now_us).cast("bigint")
    cells = F.transform_values(
        "cells", lambda _, cell: F.struct(cell["n"].alias("n"), ((now - cell["last_us"]) / F.lit(1e6)).alias("since_s"), cell["total"].alias("total"))
    )
    return rows.withColumn("cells", cells)


def feature_column(cells: Column, kind: str, now_us: Column) -> dict[str, Column]:
    """The three features of one type as plain columns: count, seconds since the last event, total."""
    cell = F.try_element_at(cells, F.lit(kind))
    return {
        "n": F.coalesce(cell["n"], F.lit(0).cast("bigint")),
        "since_s": (now_us - cell["last_us"]) / F.lit(1e6),
        "total": F.coalesce(cell["total"], F.lit(0.0)),
    }


def wide(rows: DataFrame, kinds: list[str], now_us: Column) -> DataFrame:
    """The feature table with three columns for each of the given types, none of them null but ``since_s`` of an absent type."""
    columns = [c.alias(f"{name}:{kind}") for kind in kinds for name, c in feature_column(F.col("cells"), kind, now_us).items()]
    return rows.select("entity", *columns)
