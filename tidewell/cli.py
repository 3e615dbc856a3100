"""Command line: ``python -m tidewell.cli [--source name=uri]... "SELECT ..."``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tidewell.engine import Engine, stream
from tidewell.plans.dialect import QueryError


def session(name: str = "tidewell") -> SparkSession:
    """A session with what the engine relies on: UTC, and re-planning at run time."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
    spark = builder.config("spark.sql.adaptive.enabled", "true").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidewell", description="One SELECT over files, SQLite tables and a stream of JSON lines.")
    parser.add_argument("--source", "-s", action="append", default=[], metavar="NAME=URI", help="bind a table; a table without source is standard input")
    parser.add_argument("query")
    given = parser.parse_args(argv)
    try:
        engine = Engine(spark or session(), stdin=sys.stdin)
        for binding in given.source:
            engine.add_binding(binding)
        stream(engine, given.query, out=sys.stdout)
    except QueryError as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
