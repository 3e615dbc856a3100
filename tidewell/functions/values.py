"""Typed expressions: a Spark column with the value class that the dialect sees in it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INT, REAL, TEXT, BLOB, BOOL, TIME, NULL = "int", "real", "text", "blob", "bool", "time", "null"
NUMBER = r"^\s*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)"


@dataclass(frozen=True)
class Value:
    """``kind`` is the class of all values of the column; ``affinity`` is ``num`` or ``text`` for stored columns, else None.

    ``any_`` marks texts taken out of JSON, which compare as numbers where they look like one.
    ``literal`` holds the Python value of a literal.
    """

    col: Column
    kind: str
    affinity: str | None = None
    any_: bool = False
    literal: object = None


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return BOOL
    if isinstance(data_type, T.IntegralType):
        return INT
    if isinstance(data_type, (T.DoubleType, T.FloatType, T.DecimalType)):
        return REAL
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return TIME
    if isinstance(data_type, T.BinaryType):
        return BLOB
    if isinstance(data_type, T.NullType):
        return NULL
    return TEXT


def stored(column: Column, data_type: T.DataType) -> Value:
    """A column of a table. Containers are JSON text to the dialect, decimals and floats are doubles."""
    kind = kind_of(data_type)
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        column = F.to_json(column)
    elif kind == REAL and not isinstance(data_type, T.DoubleType):
        column = column.cast("double")
    elif kind == INT and not isinstance(data_type, T.LongType):
        column = column.cast("bigint")
    return Value(column, kind, "num" if kind in (INT, REAL, BOOL) else "text" if kind == TEXT else None)


def literal(value: object) -> Value:
    if value is None:
        return Value(F.lit(None).cast("string"), NULL)
    if isinstance(value, int):
        return Value(F.lit(value).cast("bigint"), INT, literal=value)
    if isinstance(value, float):
        return Value(F.lit(value), REAL, literal=value)
    return Value(F.lit(value), TEXT, literal=value)


def number(v: Value) -> Value:
    """The value as a number: texts count by their leading number, else as 0."""
    if v.kind in (INT, REAL):
        return v
    if v.kind == BOOL:
        return Value(v.col.cast("bigint"), INT, v.affinity)
    if v.kind == NULL:
        return Value(F.lit(None).cast("bigint"), INT)
    lead = F.regexp_extract(text(v), NUMBER, 1).try_cast("double")
    return Value(F.when(v.col.isNotNull(), F.coalesce(lead, F.lit(0.0))), REAL)


def double(v: Value) -> Column:
    return number(v).col.cast("double")


def integer(v: Value) -> Column:
    """The value cut to a whole number."""
    n = number(v)
    return n.col if n.kind == INT else n.col.try_cast("bigint")


def real_text(c: Column) -> Column:
    """A double as text: always with a point, plain below 10^15, else with an exponent."""
    digits = F.regexp_replace(c.try_cast("decimal(38,15)").cast("string"), r"(\.[0-9]+?)0+$", "$1")
    size = F.abs(c)
    science = F.regexp_replace(F.regexp_replace(c.cast("string"), r"E(?=[0-9])", "e+"), r"E-([0-9])$", "e-0$1")
    return (
        F.when(c == F.lit(0.0), "0.0")
        .when((size < 1e15) & (c == F.floor(c)), F.concat(c.try_cast("bigint").cast("string"), F.lit(".0")))
        .when((size >= 1e-4) & (size < 1e15), digits)
        .when(size == F.lit(float("inf")), F.when(c > 0, "Inf").otherwise("-Inf"))
        .otherwise(F.regexp_replace(science, "E-", "e-"))
    )


def text(v: Value) -> Column:
    if v.kind in (TEXT, NULL):
        return v.col
    if v.kind == REAL:
        return real_text(v.col)
    if v.kind == BOOL:
        return v.col.cast("bigint").cast("string")
    return v.col.cast("string")


def truth(v: Value) -> Column:
    """The value as a condition: any number but 0."""
    if v.kind == BOOL:
        return v.col
    if v.kind == NULL:
        return F.lit(None).cast("boolean")
    return number(v).col != 0


def output(v: Value) -> Column:
    """The value as it is given out: conditions are 1 and 0."""
    return v.col.cast("bigint") if v.kind == BOOL else v.col


def common(values: list[Value]) -> tuple[list[Column], str]:
    """Columns of one type for values of several kinds: whole numbers, else doubles, else texts."""
    kinds = {v.kind for v in values} - {NULL}
    if not kinds:
        return [v.col for v in values], NULL
    if kinds <= {INT, BOOL}:
        return [number(v).col.cast("bigint") for v in values], INT
    if kinds <= {INT, BOOL, REAL}:
        return [number(v).col.cast("double") for v in values], REAL
    if len(kinds) == 1 and kinds & {TIME, BLOB}:
        return [v.col for v in values], kinds.pop()
    return [text(v) for v in values], TEXT


_COMPARE = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}


def compare(op: str, a: Value, b: Value) -> Value:
    """A comparison. Numbers sort before texts, unless a stored number meets a text that looks like one."""
    test = _COMPARE[op]
    if NULL in (a.kind, b.kind):
        return Value(F.lit(None).cast("boolean"), BOOL)
    numeric = (INT, REAL, BOOL)
    if a.kind in numeric and b.kind in numeric:
        return Value(test(number(a).col, number(b).col), BOOL)
    if TIME in (a.kind, b.kind) and a.kind != b.kind:
        if a.kind == TEXT:
            return Value(test(a.col.try_cast("timestamp_ntz"), b.col), BOOL)
        if b.kind == TEXT:
            return Value(test(a.col, b.col.try_cast("timestamp_ntz")), BOOL)
    if a.kind == b.kind:
        return Value(test(a.col, b.col), BOOL)
    if a.kind in numeric or b.kind in numeric:
        num, txt = (a, b) if a.kind in numeric else (b, a)
        if txt.affinity == "text" and num.affinity is None and not txt.any_:
            return Value(test(text(a), text(b)), BOOL)
        known = (num.col if a is num else txt.col).isNotNull() & (txt.col if a is num else num.col).isNotNull()
        below = F.when(known, F.lit({"=": False, "!=": True, "<": a is num, "<=": a is num, ">": a is txt, ">=": a is txt}[op]))
        if num.affinity is None and not txt.any_ and txt.affinity is None:
            return Value(below, BOOL)
        as_number = F.when(txt.col.rlike(NUMBER + r"\s*$"), F.trim(txt.col).try_cast("double"))
        numbers = test(number(a).col, as_number) if a is num else test(as_number, number(b).col)
        return Value(F.when(as_number.isNotNull(), numbers).otherwise(below), BOOL)
    return Value(test(text(a), text(b)), BOOL)


def arithmetic(op: str, left: Value, right: Value) -> Value:
    """Whole numbers stay whole, also when divided; dividing by zero gives null, and so does what outgrows 64 bits."""
    a, b = number(left), number(right)
    whole = a.kind == INT and b.kind == INT
    if op == "%":
        x, y = integer(a), integer(b)
        rest = F.when(y != 0, x % F.when(y != 0, y))
        return Value(rest, INT) if whole else Value(rest.cast("double"), REAL)
    if op == "/":
        if not whole:
            return Value(F.try_divide(a.col.cast("double"), b.col.cast("double")), REAL)
        # the least whole number has no counterpart, so dividing it by -1 goes by way of the difference
        divisor = F.when((b.col != 0) & (b.col != -1), b.col)
        return Value(F.when(b.col == -1, F.try_subtract(F.lit(0).cast("bigint"), a.col)).otherwise(F.call_function("div", a.col, divisor)), INT)
    if whole:  # a result beyond 64 bits is null
        return Value({"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a.col, b.col), INT)
    x, y = a.col.cast("double"), b.col.cast("double")
    return Value({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y}[op](), REAL)


def negative(v: Value) -> Value:
    n = number(v)
    return Value(F.try_subtract(F.lit(0).cast("bigint"), n.col) if n.kind == INT else -n.col, n.kind)


def like(subject: Value, pattern: Value) -> Value:
    """Case-insensitive for ASCII letters; % and _ are wild, nothing escapes them."""
    if subject.kind == NULL or pattern.kind == NULL:
        return Value(F.lit(None).cast("boolean"), BOOL)
    own = text(subject)
    if isinstance(pattern.literal, str) and pattern.literal.isascii():
        spare = next(c for c in "\\\x01\x02\x03\x04" if c not in pattern.literal)
        return Value(F.ilike(own, F.lit(pattern.literal), F.lit(spare)), BOOL)
    quoted = text(pattern)
    for wild, rule in (("%", r"\E.*\Q"), ("_", r"\E.\Q")):
        quoted = F.replace(quoted, F.lit(wild), F.lit(rule))
    return Value(F.regexp_like(own, F.concat(F.lit(r"(?is)\A\Q"), quoted, F.lit(r"\E\z"))), BOOL)


def glob(pattern: Value, subject: Value) -> Value:
    """Case-sensitive; * and ? are wild and [...] is a set. The pattern is a literal."""
    rule, at, p = "", 0, pattern.literal
    while at < len(p):
        close = p.find("]", at + 2) if p[at] == "[" else -1
        if p[at] in "*?":
            rule += {"*": ".*", "?": "."}[p[at]]
        elif close > 0:
            inner = p[at + 1 : close].replace("\\", "\\\\").replace("[", "\\[")
            rule += f"[{inner}]"
            at = close
        else:
            rule += "\\" + p[at] if not p[at].isalnum() else p[at]
        at += 1
    return Value(text(subject).rlike(r"(?s)\A" + rule + r"\z"), BOOL)
