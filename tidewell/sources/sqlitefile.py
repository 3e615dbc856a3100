"""SQLite tables as a Python data source: read in place, in ranges of row ids, with filters pushed down."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual,
)
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

from tidewell.plans.dialect import QueryError

#: About so many rows of one partition, and so many partitions at most.
PARTITION_ROWS, MOST_PARTITIONS = 500_000, 4_096


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quote(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _type_of(declared: str):
    """By the affinity of the declared type."""
    kind = declared.upper()
    if "INT" in kind or "BOOL" in kind:
        return LongType()
    if any(w in kind for w in ("CHAR", "CLOB", "TEXT", "DATE", "TIME")):
        return StringType()
    if "BLOB" in kind:
        return BinaryType()
    if any(w in kind for w in ("REAL", "FLOA", "DOUB", "NUM", "DEC")):
        return DoubleType()
    return StringType()


class _Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        super().__init__(None)
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType):
        self.path, self.table, self.schema = path, table, schema
        self.tests: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        signs = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            column = _quote(".".join(f.attribute)) if hasattr(f, "attribute") else ""
            if type(f) in signs and isinstance(f.value, (int, float, str)):
                self.tests.append((f"{column} {signs[type(f)]} ?", [f.value]))
            elif isinstance(f, In) and len(f.value) <= 500:
                self.tests.append((f"{column} IN ({', '.join('?' * len(f.value))})", list(f.value)))
            elif isinstance(f, (IsNull, IsNotNull)):
                self.tests.append((f"{column} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL", []))
            yield f  # Spark tests again, since a value of another class than declared may be among them

    def partitions(self) -> list[InputPartition]:
        """Ranges of row ids, cut where the ids lie: a gap of any width costs nothing."""
        table = _quote(self.table)
        with _open(self.path) as db:
            try:
                low, high, n = db.execute(f"SELECT min(rowid), max(rowid), count(*) FROM {table}").fetchone()
            except sqlite3.Error:  # a view, or a table without row ids
                return [_Range(None, None)]
            if low is None:
                return [_Range(0, 0)]
            rows = max(PARTITION_ROWS, -(-n // MOST_PARTITIONS))
            parts = []
            while low is not None:  # each step goes through one range of the ids' tree
                after = db.execute(f"SELECT rowid FROM {table} WHERE rowid >= ? ORDER BY rowid LIMIT 1 OFFSET ?", (low, rows)).fetchone()
                parts.append(_Range(low, high if after is None else after[0] - 1))
                low = after and after[0]
        return parts

    def read(self, part: _Range) -> Iterator[tuple]:
        tests, given = [t for t, _ in self.tests], [v for _, vs in self.tests for v in vs]
        if part.low is not None:
            tests.append("rowid BETWEEN ? AND ?")
            given += [part.low, part.high]
        where = f" WHERE {' AND '.join(tests)}" if tests else ""
        casts = [_cast(f.dataType) for f in self.schema.fields]
        columns = ", ".join(_quote(f.name) for f in self.schema.fields)
        with _open(self.path) as db:
            for row in db.execute(f"SELECT {columns} FROM {_quote(self.table)}{where}", given):
                yield tuple(None if v is None else cast(v) for v, cast in zip(row, casts, strict=True))


def _cast(data_type):
    def whole(v):
        return int(v) if isinstance(v, (int, float)) else None

    def real(v):
        return float(v) if isinstance(v, (int, float)) else None

    def binary(v):
        return bytes(v) if isinstance(v, (bytes, memoryview)) else str(v).encode()

    return whole if isinstance(data_type, LongType) else real if isinstance(data_type, DoubleType) else binary if isinstance(data_type, BinaryType) else str


class SqliteTable(DataSource):
    """``format("sqlite_table")`` with options ``path`` and ``table``, and ``columns`` as a JSON array of lower-case names if not all are to be read."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> StructType:
        with _open(self.options["path"]) as db:
            columns = db.execute(f"PRAGMA table_info({_quote(self.options['table'])})").fetchall()
        if not columns:
            raise QueryError(f"no such table: {self.options['table']}")
        wanted = json.loads(self.options.get("columns", "null"))
        used = [c for c in columns if wanted is None or c[1].lower() in wanted] or columns[:1]
        return StructType([StructField(c[1], _type_of(c[2] or "")) for c in used])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options["table"], schema)


def load_sqlite(spark: SparkSession, path: str, table: str, columns: set[str] | None = None) -> DataFrame:
    """A table by its declared types: INTEGER as BIGINT, REAL as DOUBLE, TEXT as STRING, BLOB as BINARY.

    Of the table those ``columns`` (in lower case) are read that it has, or all; the first one if it has none of them.
    The file must lie where every executor can read it. A value of another class than its column is null
    in a numeric column and text in a text column.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteTable)
    reader = spark.read.format("sqlite_table").option("path", path).option("table", table)
    return (reader if columns is None else reader.option("columns", json.dumps(sorted(columns)))).load()
