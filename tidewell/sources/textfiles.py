"""Which files of a path can be read line by line."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def by_lines(spark: SparkSession, path: str, odd: Column) -> tuple[list[str], list[str]]:
    """The paths to read line by line, and those to read file by file since some line in them is odd.

    One scan; what comes to the driver is names of files. Where names can't be told from patterns all files go one way.
    """
    lines = spark.read.text(path)
    found = {r[0] for r in lines.where(odd).select(F.input_file_name()).distinct().collect()}
    if not found:
        return [path], []
    files = {f: unquote(f) for f in lines.inputFiles()}
    if not found <= set(files) or any(c in name for name in files.values() for c in "*?[]{}\\"):
        return [], [path]
    return [name for f, name in files.items() if f not in found], [name for f, name in files.items() if f in found]
