"""JSON and JSON-lines files: a sequence of objects, whose keys together are the columns."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.scalar import json_text
from tidewell.sources.textfiles import by_lines

_VALUE = "value"


def flat_type(data_type: T.DataType) -> T.DataType:
    """Numbers are DOUBLE, truth values BIGINT, everything else text."""
    if isinstance(data_type, T.NumericType):
        return T.DoubleType()
    if isinstance(data_type, T.BooleanType):
        return T.LongType()
    return T.StringType()


def union_schema(inferred: T.StructType, before: T.StructType | None = None) -> T.StructType:
    """The flat schema of inferred objects, widened by what was seen before; the first type of a key stays."""
    fields = {f.name: f for f in (before.fields if before else [])}
    for f in inferred.fields:
        if f.name not in fields or isinstance(f.dataType, T.NullType):
            fields.setdefault(f.name, T.StructField(f.name, flat_type(f.dataType)))
    return T.StructType(list(fields.values()))


def _canonical(column: Column) -> Column:
    """A container's text in compact form with sorted keys."""
    packed = F.to_json(F.try_parse_json(column))
    for plain, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        packed = F.replace(packed, F.lit(plain), F.lit(code))
    return F.coalesce(packed, column)


def read_objects(lines: DataFrame, inferred: T.StructType, flat: T.StructType | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The objects in a column ``value`` as flat columns, after the columns to keep; a missing key is null."""
    flat = flat or union_schema(inferred)
    kinds = {f.name: f.dataType for f in inferred.fields}
    nested = {n for n, t in kinds.items() if isinstance(t, (T.StructType, T.ArrayType, T.MapType))}
    # truth values are read as such, then made 1 and 0
    read = T.StructType([T.StructField(f.name, T.BooleanType() if isinstance(f.dataType, T.LongType) else f.dataType) for f in flat.fields])
    parsed = lines.select(*keep, F.from_json(_VALUE, read).alias("o"))
    columns = [F.col(name) for name in keep]
    for f in flat.fields:
        own = F.col("o").getField(f.name)
        columns.append((own.cast("bigint") if isinstance(f.dataType, T.LongType) else _canonical(own) if f.name in nested else own).alias(f.name))
    return parsed.select(*columns)


def infer(spark: SparkSession, lines: DataFrame) -> T.StructType:
    """The schema of the objects in a column ``value``, with the keys of all of them."""
    texts = getattr(lines.select(_VALUE)._jdf, "as")(spark.sparkContext._jvm.org.apache.spark.sql.Encoders.STRING())
    return T.StructType.fromJson(json.loads(spark._jsparkSession.read().json(texts).schema().json()))


def _objects(texts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each file's objects up to the first error, one text each."""
    decoder = json.JSONDecoder()
    for batch in texts:
        for text in batch[_VALUE]:
            at, found = 0, []
            while True:
                while at < len(text) and text[at].isspace():
                    at += 1
                if at >= len(text):
                    break
                try:
                    value, at = decoder.raw_decode(text, at)
                except ValueError:
                    break
                if not isinstance(value, dict):
                    break
                found.append(json_text(value))
            yield pd.DataFrame({_VALUE: found}, dtype=object)


def load_json(spark: SparkSession, path: str) -> DataFrame:
    """The union of all keys is the schema: numbers DOUBLE, truth values BIGINT, texts STRING, containers as JSON text.

    In files where every line holds one object, as in JSON lines, lines are parsed in parallel. Any other
    file is taken as a sequence of objects, of any layout, up to its first error. An array or a scalar at
    the top is such an error. An empty file gives no columns and no rows.
    """
    filled = F.trim(_VALUE) != ""
    # an object that fills its line is valid JSON text and begins with a brace
    parts, whole = by_lines(spark, path, filled & ~(F.trim(_VALUE).startswith("{") & F.try_parse_json(_VALUE).isNotNull()))
    frames = [spark.read.text(parts).where(filled)] if parts else []
    frames += [spark.read.text(whole, wholetext=True).mapInPandas(_objects, f"{_VALUE} string")] if whole else []
    lines = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
    inferred = infer(spark, lines)
    if not inferred.fields:
        return spark.createDataFrame([], "struct<>")
    return read_objects(lines, inferred)
