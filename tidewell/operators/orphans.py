"""References to records that do not exist, at the time they are made."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.runtime import write_and_read

#: A key's records are spread over so many join tasks.
SALTS = 16
#: So many keys are broadcast at most, some 150 bytes each in the broadcast table.
BROADCAST_KEYS = 400_000
CAUSES = ("missing", "not_yet_created", "already_deleted")


@dataclass(frozen=True)
class Parent:
    """A table whose rows are referred to.

    ``version`` orders the versions of one key; the greatest is current. ``created`` and
    ``deleted`` are its life span in microseconds.
    """

    name: str
    rows: DataFrame
    key: Column
    version: Column
    created: Column
    deleted: Column


@dataclass(frozen=True)
class Reference:
    """A field of a table that refers to ``parent``; ``record`` identifies the record, ``time`` is in microseconds.

    With ``timed`` a row without time is no record. Fields that share ``rows``, ``record`` and ``time`` are read in one scan.
    """

    parent: str
    table: str
    field: str
    rows: DataFrame
    key: Column
    record: Column
    time: Column
    timed: bool = False


def _union(frames: list[DataFrame]) -> DataFrame:
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def _scans(references: list[Reference]) -> list[list[Reference]]:
    """The references by the scan that serves them."""
    scans: dict[tuple, list[Reference]] = {}
    for r in references:
        scans.setdefault((r.table, id(r.rows), id(r.record), id(r.time), r.timed), []).append(r)
    return list(scans.values())


def _keyed(scan: list[Reference], keep: list[Column]) -> DataFrame:
    """Columns of the rows, and one row for each field with a key: ``__ref`` has ``parent``, ``key`` and ``ref_field``."""
    own = [F.struct(F.lit(r.parent).alias("parent"), r.key.alias("key"), F.lit(r.field).alias("ref_field")) for r in scan]
    ref = own[0] if len(own) == 1 else F.explode(F.array(*own))
    return scan[0].rows.select(*keep, ref.alias("__ref")).where(F.col("__ref.key").isNotNull())


def broken_keys(parents: list[Parent], references: list[Reference]) -> DataFrame:
    """Group tagged parent and child keys in long form; keep the groups with a reference that doesn't hold.

    Parents and children are brought to one long form and grouped by parent table and key, so no
    table is joined. Child rows enter as counts and time ranges, which combine map-side: a hot key
    shuffles one state per input partition. Kept are groups without a parent, and groups whose
    range of times leaves the life span of the parent's current version.
    """
    none = F.lit(None).cast("bigint")
    current = [
        p.rows.where(p.key.isNotNull())
        .groupBy(p.key.alias("key"))
        .agg(F.max(F.struct(p.version.alias("version"), p.created.alias("created"), p.deleted.alias("deleted"))).alias("life"))
        .select(F.lit(p.name).alias("parent"), "key", F.lit(1).alias("is_parent"), "life.created", "life.deleted", none.alias("t"))
        for p in parents
    ]
    # a time isn't asked for before the groups are made: it would be worked out twice, for the test and for the range
    children = [
        _keyed(scan, [scan[0].time.alias("t")]).select(
            "__ref.parent", "__ref.key", F.lit(0).alias("is_parent"), none.alias("created"), none.alias("deleted"), "t", F.lit(scan[0].timed).alias("timed")
        )
        for scan in _scans(references)
    ]
    child_row = (F.col("is_parent") == 0) & (F.col("t").isNotNull() | ~F.col("timed"))
    groups = (
        _union([*(c.withColumn("timed", F.lit(False)) for c in current), *children])
        .groupBy("parent", "key")
        .agg(
            F.max("is_parent").alias("known"), F.max("created").alias("created"), F.max("deleted").alias("deleted"), F.min("t").alias("first_t"),
            F.max("t").alias("last_t"), F.count_if(child_row).alias("n_children"),
        )
    )
    outside = F.coalesce(F.col("first_t") < F.col("created"), F.lit(False)) | F.coalesce(F.col("last_t") >= F.col("deleted"), F.lit(False))
    return groups.where((F.col("n_children") > 0) & ((F.col("known") == 0) | outside)).select("parent", "key", "known", "created", "deleted", "n_children")


def orphan_references(parents: list[Parent], references: list[Reference], broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """One row for each distinct record and field whose reference doesn't hold.

    Columns: ``ref_table``, ``ref_field``, ``record_id``, ``period`` (Monday of the record's UTC
    week) and ``cause`` (``missing``, ``not_yet_created`` or ``already_deleted``). A reference holds
    if its key names a row whose current version was created at or before the record's time and
    deleted after it or not at all. Null keys refer to nothing. A record without time can only be
    ``missing``, and has a null period. A null ``created`` or ``deleted`` sets no limit. NaN keys
    name no row. Records stored more than once come out once; a null record id is one record.
    Empty tables give no rows, or only missing ones if the parents are empty.

    The keys found by ``broken_keys`` are written to the shared folder and counted, then joined back to their
    records: up to ``broadcast_keys`` of them are broadcast, so that no record is shuffled. Of more keys those that hold
    more than their share of the records, and so are fewer than ``broadcast_keys``, are broadcast; the others meet the
    records in a shuffle, where both sides carry a salt taken from the record, so that the records of a hot key that isn't
    broken go to ``SALTS`` tasks. That join is a merge whatever Spark estimates: it goes by the bytes of the key files, which
    are packed and lack the copies by salt, and so would have the driver gather far more than its threshold.
    """
    broken = write_and_read(broken_keys(parents, references), "broken-keys").withColumnsRenamed({"parent": "__parent", "key": "__key"})
    n_keys, n_records = broken.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_children"), F.lit(0))).first()
    share = n_records // max(1, broadcast_keys)
    few = broken if n_keys <= broadcast_keys else broken.where(F.col("n_children") > share)
    rest = None if n_keys <= broadcast_keys else broken.where(F.col("n_children") <= share)
    same = (F.col("__ref.parent") == F.col("__parent")) & (F.col("__ref.key") == F.col("__key"))
    found = []
    for scan in _scans(references):
        rows = _keyed(scan, [F.col("*")])
        hits = [rows.join(F.broadcast(few), same)]
        if rest is not None:
            salted = rest.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
            own = rows.withColumn("__own", F.pmod(F.hash(scan[0].record), F.lit(SALTS)))
            hits.append(own.join(salted, same & (F.col("__own") == F.col("__salt"))))
        for hit in hits:  # times are worked out for what the join leaves
            found.append(
                hit.select(
                    F.lit(scan[0].table).alias("ref_table"), "__ref.ref_field", scan[0].record.alias("record_id"), scan[0].time.alias("t"),
                    "known", "created", "deleted", F.lit(scan[0].timed).alias("timed"),
                )
            )
    found = _union(found)
    cause = F.when(F.col("timed") & F.col("t").isNull(), None).when(F.col("known") == 0, 1).when(F.col("t") < F.col("created"), 2).when(F.col("t") >= F.col("deleted"), 3)
    # 1970-01-01 was a Thursday; days since the Monday before it, in UTC and free of the session's zone
    day = F.floor(F.col("t") / F.lit(86_400_000_000)).cast("int")
    found = found.withColumns({"cause": cause, "monday": day - F.pmod(day + F.lit(3), F.lit(7))}).where(F.col("cause").isNotNull())
    once = found.groupBy("ref_table", "ref_field", "record_id").agg(F.min("monday").alias("monday"), F.min("cause").alias("cause"))
    return once.select(
        "ref_table", "ref_field", "record_id", F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.col("monday")), "yyyy-MM-dd").alias("period"),
        F.element_at(F.array(*map(F.lit, CAUSES)), F.col("cause")).alias("cause"),
    )


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """The number of orphan references for each table, field, period and cause."""
    return orphans.groupBy("ref_table", "ref_field", "period", "cause").agg(F.count(F.lit(1)).alias("n_orphans"))
