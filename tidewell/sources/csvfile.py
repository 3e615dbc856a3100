"""CSV files: the first row names the columns, types are inferred from all cells."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.sources.textfiles import by_lines

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^(?i)[+-]?(inf|infinity|nan)$"
# Cells that count as true and false where a whole column consists of them
_TRUE, _FALSE = ("1", "t", "T", "TRUE", "true", "True"), ("0", "f", "F", "FALSE", "false", "False")


def to_number(cell: Column) -> Column:
    """A numeric cell as a double; an empty one is null."""
    return F.when(cell.rlike(_NUMBER), cell.try_cast("double"))


def _read(spark: SparkSession, path: str, **options) -> DataFrame:
    """Records of the files; one that goes over several lines makes only its own file be read as a whole."""
    quotes = F.char_length("value") - F.char_length(F.replace("value", F.lit('"'), F.lit("")))
    parts, whole = by_lines(spark, path, quotes % 2 == 1)
    reader = spark.read.options(header=True, escape='"', columnPruning=False, **{k: v for k, v in options.items() if k != "schema"})
    reader = reader.schema(options["schema"]) if "schema" in options else reader
    frames = [reader.options(multiLine=multi).csv(names) for multi, names in ((False, parts), (True, whole)) if names]
    return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1], allowMissingColumns=True)


def _tolerant(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """All records, as ``c0``, ``c1`` and so on, with those of another number of fields in ``bad``."""
    schema = ", ".join([*(f"c{k} string" for k in range(len(names))), "bad string"])
    return _read(spark, path, schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord="bad")


def left_out(spark: SparkSession, path: str) -> DataFrame:
    """The records that ``load_csv`` leaves out, as they stand in the file, under ``record``."""
    names = _read(spark, path).columns
    if not names:
        return spark.createDataFrame([], "record string")
    rows = _tolerant(spark, path, names)
    # no character of a field is taken, but it is named, since the reader refuses to give bad records alone
    return rows.where(F.col("bad").isNotNull()).select(F.concat("bad", F.substring(F.coalesce("c0", F.lit("")), 1, 0)).alias("record"))


def load_csv(spark: SparkSession, path: str) -> DataFrame:
    """Columns of numbers are DOUBLE, of true and false BIGINT 1 and 0, others STRING.

    All cells of a column decide, in one pass over the file. An empty cell is null in a numeric
    column, and the empty text elsewhere. Rows with another number of fields than the header are
    left out; how many is told on standard error, and ``left_out`` has them. An empty file has no columns and no rows, a
    file with a header only has string columns.
    """
    raw = _read(spark, path, mode="DROPMALFORMED")
    if not raw.columns:
        return spark.createDataFrame([], "struct<>")
    names = raw.columns
    raw = raw.toDF(*(f"c{k}" for k in range(len(names))))
    cells = {k: F.coalesce(F.col(f"c{k}"), F.lit("")) for k in range(len(names))}
    good = F.col("bad").isNull()
    checks = [F.count_if(~good).alias("n_bad")]
    for k, cell in cells.items():
        checks += [
            F.count_if(good & (cell != "") & ~cell.rlike(_NUMBER)).alias(f"other{k}"), F.count_if(good & (cell != "")).alias(f"filled{k}"),
            F.count_if(good & ~cell.isin(*_TRUE, *_FALSE)).alias(f"unlike{k}"),
        ]
    seen = _tolerant(spark, path, names).agg(*checks).first()
    if seen["n_bad"]:
        print(f"{path}: {seen['n_bad']} rows with another number of fields than the header are left out", file=sys.stderr)
    columns = []
    for k, name in enumerate(names):
        if seen[f"filled{k}"] and not seen[f"other{k}"]:
            column = to_number(cells[k])
        elif seen[f"filled{k}"] and not seen[f"unlike{k}"]:
            column = F.when(cells[k].isin(*_TRUE), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
        else:
            column = cells[k]
        columns.append(column.alias(name))
    return raw.select(*columns)
