"""The engine: named sources, one query."""

from __future__ import annotations

import sys
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession

from tidewell.plans.dialect import Binary, Name, QueryError, Select, Star, parse_one
from tidewell.plans.lowering import Relation, lower, walk
from tidewell.sink import write_lines
from tidewell.sources.csvfile import load_csv
from tidewell.sources.jsonfile import load_json
from tidewell.sources.sqlitefile import load_sqlite
from tidewell.sources.stdin import load_stdin
from tidewell.sources.uri import PARQUET, SQLITE, STDIN, SourceSpec, parse_binding, parse_uri

LOADERS = {
    "csv": lambda spark, spec, _: load_csv(spark, spec.path),
    "json": lambda spark, spec, _: load_json(spark, spec.path),
    SQLITE: lambda spark, spec, _: load_sqlite(spark, spec.path, spec.table),
    PARQUET: lambda spark, spec, _: spark.read.parquet(spec.path),
    STDIN: lambda spark, _, stdin: load_stdin(spark, stdin),
}
ATTACHED, INDEXED, FULL_SCAN = "attached", "indexed", "full_scan"


class Engine:
    """``Engine(spark).add_source("users", "file://users.csv").sql("SELECT ...")``.

    With ``empty_source_is_absent`` a query that names a file or standard input without any record gives no
    rows at all, not even a count of 0 or the kept rows of an outer join. Tables of SQLite and Parquet and
    frames are there also when they are empty.
    """

    def __init__(self, spark: SparkSession, empty_source_is_absent: bool = True, stdin: TextIO | None = None):
        self.spark, self.empty_source_is_absent, self.stdin = spark, empty_source_is_absent, stdin
        self.specs: dict[str, SourceSpec] = {}
        self.frames: dict[str, DataFrame] = {}

    # --- sources

    def add_source(self, name: str, uri: str) -> Engine:
        """Bind a name; binding it again replaces the source."""
        self.frames.pop(name, None)
        self.specs[name] = parse_uri(name, uri)
        return self

    def add_binding(self, text: str) -> Engine:
        spec = parse_binding(text)
        self.frames.pop(spec.name, None)
        self.specs[spec.name] = spec
        return self

    def add_frame(self, name: str, frame: DataFrame) -> Engine:
        self.specs.pop(name, None)
        self.frames[name] = frame
        return self

    def bind_stdin(self, statement: Select, others=()) -> None:
        """A table without source is standard input; there may be one such table, used as often as one likes."""
        known = {n.lower() for n in (*self.specs, *self.frames, *others)}
        unbound = list(dict.fromkeys(t.name for t in statement.tables() if t.name.lower() not in known))
        if len(unbound) > 1:
            raise QueryError(f"only one table can be standard input: {', '.join(unbound)}")
        for name in unbound:
            self.specs[name] = SourceSpec(name, STDIN)

    def frame(self, name: str) -> DataFrame:
        if name not in self.frames:
            spec = self.specs[name]
            self.frames[name] = LOADERS[spec.format](self.spark, spec, self.stdin)
        return self.frames[name]

    def _named(self, statement: Select) -> list[str]:
        used = {t.name.lower() for t in statement.tables()}
        return [n for n in (*self.specs, *(f for f in self.frames if f not in self.specs)) if n.lower() in used]

    # --- queries

    def sql(self, text: str) -> DataFrame:
        """The first statement of a text as a lazy DataFrame, over all that the sources hold now. EVERY without OVER has no effect."""
        statement = parse_one(text)
        self.bind_stdin(statement)
        return self.run(statement)

    def run(self, statement: Select) -> DataFrame:
        names = self._named(statement)
        relations = {n: Relation(self._used(n, statement)) for n in names}
        absent = self.empty_source_is_absent and any(
            self.specs[n].format in ("csv", "json", STDIN) and (not relations[n].frame.columns or relations[n].frame.isEmpty()) for n in names if n in self.specs
        )
        if absent:
            return self._nothing(statement, relations)
        return lower(self.spark, statement, relations)

    def _used(self, name: str, statement: Select) -> DataFrame:
        """A source with the columns that the statement can mean; the others of a SQLite table aren't even read."""
        spec = self.specs.get(name)
        if spec is None or spec.format != SQLITE or any(isinstance(i.expr, Star) for i in statement.items):
            return self.frame(name)
        roots = [*(i.expr for i in statement.items), *(j.on for j in statement.joins), *statement.group, *(e for e, _ in statement.order)]
        roots += [statement.where] if statement.where is not None else []
        return load_sqlite(self.spark, spec.path, spec.table, {e.column.lower() for r in roots for e in walk(r) if isinstance(e, Name)})

    def _nothing(self, statement: Select, relations: dict[str, Relation]) -> DataFrame:
        try:
            return lower(self.spark, statement, relations).limit(0)
        except QueryError:  # a file without records has no columns to bind
            return self.spark.createDataFrame([], "struct<>")

    def print(self, text: str, out: TextIO | None = None) -> int:
        """Run a query and print its rows as JSON lines."""
        return write_lines(self.sql(text), out or sys.stdout)

    # --- access paths of static tables next to streams

    def explain_access(self, text: str) -> dict[str, str]:
        """How each static table of a streamed query is reached.

        ``attached``: a SQLite table, read in place. ``indexed``: joined by one equality of a column of its own
        with one of another table, so Spark may broadcast it to a hash join. ``full_scan``: anything else.
        """
        statement = parse_one(text)
        found = {}
        for table in statement.tables():
            spec = self.specs.get(table.name)
            if spec is None and table.name not in self.frames or spec is not None and spec.streaming:
                continue
            if spec is not None and spec.format == SQLITE:
                found[table.name] = ATTACHED
            elif table is not statement.table and any(j.table is table and _joins_by_key(j.on, table.alias) for j in statement.joins):
                found[table.name] = INDEXED
            else:
                found[table.name] = FULL_SCAN
        return found


def _joins_by_key(on, alias: str) -> bool:
    if not (isinstance(on, Binary) and on.op == "=" and isinstance(on.left, Name) and isinstance(on.right, Name)):
        return False
    own = [n.table is not None and n.table.lower() == alias.lower() for n in (on.left, on.right)]
    return own[0] != own[1]


def stream(engine: Engine, text: str, inputs: dict | None = None, out: TextIO | None = None, **options) -> None:
    """Run a query; with a positive OVER as a windowed one over ``inputs`` (standard input if none are given), else once."""
    from tidewell.sources.stdin import records
    from tidewell.streaming.run import run_stream

    statement = parse_one(text)
    inputs = dict(inputs or {})
    engine.bind_stdin(statement, inputs)
    if not statement.over_us or statement.over_us < 0:
        for name, given in inputs.items():
            engine.add_frame(name, _table_of(engine.spark, given))
        write_lines(engine.run(statement), out or sys.stdout)
        return
    for name, spec in engine.specs.items():
        if spec.streaming and name not in inputs:
            inputs[name] = records(engine.stdin or sys.stdin)
    if not inputs:
        raise QueryError("OVER requires at least one streaming source")
    statics = {n: engine.frame(n) for n in (*engine.specs, *engine.frames) if n not in inputs and n in {t.name for t in statement.tables()}}
    run_stream(engine.spark, statement, inputs, statics, out or sys.stdout, **options)


def _table_of(spark: SparkSession, given) -> DataFrame:
    """Records of an in-memory stream as a table, read to its end."""
    import io
    import json

    return load_stdin(spark, io.StringIO("".join(json.dumps(r) + "\n" for r in given)))
