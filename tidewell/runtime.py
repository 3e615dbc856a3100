"""Session-level helpers: the shared folder, Hadoop file calls and key handling."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest double below which every whole number is exact and fits a BIGINT.
EXACT_DOUBLE = float(2**53)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only where that is unset, as in
    local tests, a temporary folder is made and set for this session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidewell-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


_MADE: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path of its own below the shared folder. It stays, as lazy results may read it, until ``drop_scratch`` or the end of the process."""
    if not _MADE:
        atexit.register(_at_exit, spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def _at_exit(spark: SparkSession) -> None:
    try:
        drop_scratch(spark)
    except Exception:  # noqa: BLE001 - the session is over, so nothing can be reached any more
        pass


def drop_scratch(spark: SparkSession) -> None:
    """Delete all that this process wrote to the shared folder; call it once the results have been used."""
    while _MADE:
        remove_path(spark, _MADE.pop())


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path through the Hadoop file system that owns it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def child_names(spark: SparkSession, path: str, holding: str | None = None) -> list[str]:
    """The names of what lies under a path, or of the folders there that hold a file of the given name; none if there is no such path."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [entry.getPath() for entry in system.listStatus(where)] if system.exists(where) else []
    return [child.getName() for child in found if holding is None or system.exists(jvm.org.apache.hadoop.fs.Path(child, holding))]


def path_bytes(spark: SparkSession, path: str) -> int:
    """The bytes of all files under a path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def exact_double_key(key: Column) -> Column:
    """A DOUBLE key as BIGINT; null where it is null, not whole or too large to be exact."""
    whole = (key == F.floor(key)) & (F.abs(key) <= F.lit(EXACT_DOUBLE))
    return F.when(whole, key).try_cast("bigint")


def inexact_keys(rows: DataFrame, part: str, keys: list[str]) -> DataFrame:
    """What ``exact_double_key`` leaves out: for each part and key field the rows, and those whose key is given but isn't an exact whole number.

    Columns ``part``'s name, ``field``, ``n_rows`` and ``n_inexact``. An empty input gives no rows.
    """
    counts = [F.count_if(F.col(k).isNotNull() & exact_double_key(F.col(k)).isNull()).alias(k) for k in keys]
    found = rows.groupBy(part).agg(F.count(F.lit(1)).alias("n_rows"), F.struct(*counts).alias("by"))
    fields = F.explode(F.array(*(F.struct(F.lit(k).alias("field"), F.col("by")[k].alias("n_inexact")) for k in keys))).alias("f")
    return found.select(part, "n_rows", fields).select(part, "f.field", "n_rows", "f.n_inexact")


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 UTC of a timestamp column; one without zone means UTC, whatever the session's zone."""
    column = F.col(name)
    if dict(df.dtypes)[name] == "timestamp_ntz":
        zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
        if zone not in ("UTC", "Etc/UTC", "GMT", "Z"):
            column = F.convert_timezone(F.lit("UTC"), F.lit(zone), column)
    return F.unix_micros(column.cast("timestamp"))


def write_and_read(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage through a table in the shared folder, which survives a lost executor."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
