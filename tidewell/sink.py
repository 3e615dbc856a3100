"""Rows as JSON lines."""

from __future__ import annotations

import base64
import datetime
import json
import math
from collections.abc import Iterable
from decimal import Decimal
from typing import TextIO

from pyspark.sql import DataFrame, Row


def number_text(value: float) -> str:
    """The shortest text of a double: whole numbers without a point, an exponent below 1e-6 and from 1e21 on."""
    if math.isinf(value) or math.isnan(value):
        raise ValueError("JSON has no infinite numbers")
    if value == 0:
        return "-0" if math.copysign(1, value) < 0 else "0"
    digits = Decimal(repr(value))
    if 1e-6 <= abs(value) < 1e21:
        plain = format(digits, "f")
        return plain.rstrip("0").rstrip(".") if "." in plain else plain
    sign, figures, exponent = digits.normalize().as_tuple()
    power = exponent + len(figures) - 1
    mantissa = str(figures[0]) + ("." + "".join(map(str, figures[1:])) if len(figures) > 1 else "")
    return f"{'-' if sign else ''}{mantissa}e{'-' if power < 0 else '+'}{abs(power):02d}"


def value_text(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "1" if value else "0"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return number_text(value)
    if isinstance(value, Decimal):
        return number_text(float(value))
    if isinstance(value, (bytes, bytearray)):
        return f'"{base64.b64encode(bytes(value)).decode()}"'
    if isinstance(value, (datetime.datetime, datetime.date)):
        value = str(value)
    if isinstance(value, (list, dict, Row)):
        value = json.dumps(value, default=str, sort_keys=True, separators=(",", ":"))
    text = json.dumps(str(value), ensure_ascii=False)
    for plain in "<>&\u2028\u2029":
        text = text.replace(plain, f"\\u{ord(plain):04x}")
    return text


def row_text(names: list[str], row: Iterable) -> str:
    """One object; its keys are sorted, and of equal names the last value stays."""
    pairs = dict(zip(names, row, strict=True))
    return "{" + ",".join(f"{value_text(k)}:{value_text(pairs[k])}" for k in sorted(pairs)) + "}"


def write_lines(frame: DataFrame, out: TextIO) -> int:
    """Print a result row by row; partitions come to the driver one after the other. For bulk use ``frame.write``."""
    n, names = 0, frame.columns
    for row in frame.toLocalIterator(prefetchPartitions=True):
        out.write(row_text(names, row) + "\n")
        n += 1
    out.flush()
    return n
