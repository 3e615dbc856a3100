"""JSON lines on standard input, spooled to a file that executors can read."""

from __future__ import annotations

import json
import sys
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession

from tidewell.functions.scalar import json_text
from tidewell.runtime import scratch_path
from tidewell.sources.jsonfile import load_json


def records(stream: TextIO):
    """The objects of a stream of JSON lines, up to the first error, which is told on standard error."""
    for line in stream:
        if not line.strip():
            continue
        try:
            value = json.loads(line)
            if not isinstance(value, dict):
                raise ValueError("a record must be an object")
        except ValueError as error:
            print(f"standard input: {error}", file=sys.stderr)
            return
        yield value


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file through the Hadoop file system, first under a hidden name and then moved into place."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    hidden = jvm.org.apache.hadoop.fs.Path(target.getParent(), "." + target.getName())
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = system.create(hidden, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    system.rename(hidden, target)


def load_stdin(spark: SparkSession, stream: TextIO | None = None, block: int = 4 << 20) -> DataFrame:
    """All of standard input as a table; it is spooled in blocks to the shared folder."""
    folder, held, size, n = scratch_path(spark, "stdin"), [], 0, 0

    def flush() -> None:
        nonlocal held, size, n
        if held or not n:
            write_text(spark, f"{folder}/part-{n:06d}.jsonl", "".join(held))
            held, size, n = [], 0, n + 1

    for value in records(stream or sys.stdin):
        held.append(json_text(value) + "\n")
        size += len(held[-1])
        if size >= block:
            flush()
    flush()
    return load_json(spark, folder)
