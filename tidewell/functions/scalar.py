"""The dialect's scalar functions as column builders, with an Arrow-batched fallback for the odd ones."""

from __future__ import annotations

import json
import math
import re
import sqlite3
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.values import (
    BLOB, BOOL, INT, NULL, REAL, TEXT, TIME, Value, common, double, glob, integer, like, literal, number, real_text, text, truth,
)

Builder = Callable[[list[Value]], Value]
FUNCTIONS: dict[str, Builder] = {}
_ARITY: dict[str, tuple[int, int]] = {}
_MANY = 99


def function(*names: str, least: int = 1, most: int | None = None) -> Callable[[Builder], Builder]:
    def add(builder: Builder) -> Builder:
        for name in names:
            FUNCTIONS[name], _ARITY[name] = builder, (least, most or least)
        return builder

    return add


def call(name: str, args: list[Value]) -> Value:
    if name not in FUNCTIONS:
        raise ValueError(f"no such function: {name}")
    least, most = _ARITY[name]
    if not least <= len(args) <= most:
        raise ValueError(f"wrong number of arguments to {name}()")
    return FUNCTIONS[name](args)


def _any_null(args: list[Value]) -> Column:
    test = args[0].col.isNull()
    for a in args[1:]:
        test = test | a.col.isNull()
    return test


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


# --- text

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@function("UPPER")
def _upper(a):
    return Value(F.translate(text(a[0]), _LOWER, _UPPER), TEXT)  # ASCII letters only


@function("LOWER")
def _lower(a):
    return Value(F.translate(text(a[0]), _UPPER, _LOWER), TEXT)


@function("LENGTH")
def _length(a):
    return Value((F.octet_length(a[0].col) if a[0].kind == BLOB else F.char_length(text(a[0]))).cast("bigint"), INT)


@function("SUBSTR", "SUBSTRING", least=2, most=3)
def _substr(a):
    """Position 0 stands before the first character; a negative length takes what is before the position."""
    s, size = text(a[0]), F.char_length(text(a[0])).cast("bigint")
    at, n = (F.greatest(F.least(integer(x), F.lit(2**40)), F.lit(-(2**40))) for x in (a[1], a[2] if len(a) == 3 else literal(2**40)))
    begin = F.when(at < 0, size + at + 1).otherwise(at)
    low, high = F.when(n < 0, begin + n).otherwise(begin), F.when(n < 0, begin).otherwise(begin + n)
    low, high = F.least(F.greatest(low, F.lit(1)), size + 1), F.least(high, size + 1)
    cut = F.substring(s, low.cast("int"), F.greatest(high - low, F.lit(0)).cast("int"))
    return Value(F.when(~_any_null(a), cut), TEXT)


def _trimmer(plain, sided: str):
    def build(a):
        if len(a) == 1:
            return Value(plain(text(a[0])), TEXT)
        if not isinstance(a[1].literal, str):
            return Value({"both": F.btrim, "left": F.ltrim, "right": F.rtrim}[sided](text(a[0]), text(a[1])), TEXT)
        inside = "".join("\\" + c if not c.isalnum() else c for c in a[1].literal)
        rules = {"both": f"^[{inside}]+|[{inside}]+$", "left": f"^[{inside}]+", "right": f"[{inside}]+$"}
        return Value(F.regexp_replace(text(a[0]), rules[sided], "") if inside else text(a[0]), TEXT)

    return build


function("TRIM", least=1, most=2)(_trimmer(F.trim, "both"))
function("LTRIM", least=1, most=2)(_trimmer(F.ltrim, "left"))
function("RTRIM", least=1, most=2)(_trimmer(F.rtrim, "right"))


@function("REPLACE", least=3)
def _replace(a):
    s, old, new = map(text, a)
    return Value(F.when(_any_null(a), None).when(old == "", s).otherwise(F.replace(s, old, new)), TEXT)


@function("INSTR", least=2)
def _instr(a):
    return Value(F.call_function("locate", text(a[1]), text(a[0])).cast("bigint"), INT)


@function("CHAR", least=0, most=_MANY)
def _char(a):
    return Value(F.concat_ws("", *(F.decode(F.unhex(F.lpad(F.hex(integer(x)), 8, "0")), "UTF-32") for x in a)), TEXT)


@function("UNICODE")
def _unicode(a):
    return Value(F.when(text(a[0]) != "", F.conv(F.hex(F.encode(F.substring(text(a[0]), 1, 1), "UTF-32")), 16, 10).cast("bigint")), INT)


@function("OCTET_LENGTH")
def _octet_length(a):
    return Value(F.octet_length(a[0].col if a[0].kind == BLOB else text(a[0])).cast("bigint"), INT)


@function("ZEROBLOB")
def _zeroblob(a):
    return Value(F.unhex(F.repeat(F.lit("00"), F.greatest(integer(a[0]), F.lit(0)).cast("int"))), BLOB)


@function("HEX")
def _hex(a):
    return Value(F.coalesce(F.hex(a[0].col if a[0].kind == BLOB else text(a[0])), F.lit("")), TEXT)


@function("UNHEX")
def _unhex(a):
    return Value(F.try_to_binary(text(a[0]), F.lit("hex")), BLOB)


@function("QUOTE")
def _quote(a):
    if a[0].kind == NULL:
        return Value(F.lit("NULL"), TEXT)
    quoted = F.concat(F.lit("'"), F.replace(text(a[0]), F.lit("'"), F.lit("''")), F.lit("'")) if a[0].kind in (TEXT, TIME) else text(a[0])
    return Value(F.coalesce(quoted, F.lit("NULL")), TEXT)


@function("CONCAT", most=_MANY)
def _concat(a):
    return Value(F.concat_ws("", *map(text, a)), TEXT)


@function("CONCAT_WS", least=2, most=_MANY)
def _concat_ws(a):
    joined = F.array_join(F.array_compact(F.array(*map(text, a[1:]))), a[0].literal) if isinstance(a[0].literal, str) else None
    if joined is None:
        joined = F.call_function("concat_ws", text(a[0]), *map(text, a[1:]))
    return Value(joined, TEXT)


@function("LIKE", least=2)
def _like(a):
    return like(a[1], a[0])


@function("GLOB", least=2)
def _glob(a):
    return glob(a[0], a[1]) if isinstance(a[0].literal, str) else _by_engine("glob", INT)(a)


@function("SOUNDEX")
def _soundex(a):
    code = F.soundex(F.regexp_replace(text(a[0]), "^[^A-Za-z]+", ""))
    return Value(F.when(text(a[0]).rlike("[A-Za-z]"), code).otherwise("?000"), TEXT)


# --- numbers


@function("ABS")
def _abs(a):
    n = number(a[0])
    return Value(F.abs(n.col), n.kind)


@function("SIGN")
def _sign(a):
    return Value(F.signum(double(a[0])).cast("bigint"), INT) if a[0].kind in (INT, REAL, BOOL) else Value(F.lit(None).cast("bigint"), INT)


@function("ROUND", least=1, most=2)
def _round(a):
    """Half away from zero, always a double."""
    x, digits = double(a[0]), a[1].literal if len(a) == 2 else 0
    if isinstance(digits, int):
        return Value(F.round(x, max(0, digits)), REAL)
    n = F.greatest(integer(a[1]), F.lit(0))
    scale = F.pow(F.lit(10.0), n)
    return Value(F.signum(x) * F.floor(F.abs(x) * scale + 0.5).cast("double") / scale, REAL)


def _whole(build):
    def made(a):
        n = number(a[0])
        return n if n.kind == INT else Value(build(n.col).cast("double"), REAL)

    return made


function("CEIL", "CEILING")(_whole(F.ceil))
function("FLOOR")(_whole(F.floor))
function("TRUNC")(_whole(lambda c: F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c))))


@function("MOD", least=2)
def _mod(a):
    x, y = double(a[0]), double(a[1])
    return Value(F.when(y != 0, x % F.when(y != 0, y)), REAL)


@function("POW", "POWER", least=2)
def _pow(a):
    return Value(_finite(F.pow(double(a[0]), double(a[1]))), REAL)


@function("LOG", least=1, most=2)
def _log(a):
    """To base 10, or to the base given first."""
    if len(a) == 1:
        return Value(F.log10(double(a[0])), REAL)
    x, base = double(a[1]), double(a[0])
    return Value(F.when((x > 0) & (base > 0) & (base != 1), F.log(F.when(x > 0, x)) / F.log(F.when((base > 0) & (base != 1), base))), REAL)


for _name, _build in {
    "SQRT": F.sqrt, "EXP": F.exp, "LN": F.ln, "LOG10": F.log10, "LOG2": F.log2, "SIN": F.sin, "COS": F.cos, "TAN": F.tan, "ASIN": F.asin, "ACOS": F.acos,
    "ATAN": F.atan, "SINH": F.sinh, "COSH": F.cosh, "TANH": F.tanh, "ASINH": F.asinh, "ACOSH": F.acosh, "ATANH": F.atanh, "DEGREES": F.degrees, "RADIANS": F.radians,
}.items():
    function(_name)(lambda a, build=_build: Value(_finite(build(double(a[0]))), REAL))


@function("ATAN2", least=2)
def _atan2(a):
    return Value(F.atan2(double(a[0]), double(a[1])), REAL)


@function("PI", least=0, most=1)
def _pi(a):
    return Value(F.lit(math.pi), REAL, literal=math.pi)


@function("RANDOM", least=0, most=1)
def _random(a):
    return Value(((F.rand() - 0.5) * 2.0**63 * 2).try_cast("bigint"), INT)


@function("RANDOMBLOB")
def _randomblob(a):
    n = F.greatest(integer(a[0]), F.lit(1)).cast("int")
    return Value(F.unhex(F.substring(F.sha2(F.rand().cast("string"), 512), F.lit(1), n * 2)), BLOB)


# --- null and choice


@function("COALESCE", "IFNULL", least=2, most=_MANY)
def _coalesce(a):
    columns, kind = common(a)
    return Value(F.coalesce(*columns), kind)


@function("NULLIF", least=2)
def _nullif(a):
    from tidewell.functions.values import compare

    equal = F.coalesce(compare("=", a[0], a[1]).col, F.lit(False))
    return Value(F.when(~equal, a[0].col), a[0].kind)


@function("IIF", "IF", least=2, most=3)
def _iif(a):
    columns, kind = common(a[1:])
    chosen = F.when(truth(a[0]), columns[0])
    return Value(chosen.otherwise(columns[1]) if len(columns) == 2 else chosen, kind)


def _extreme(build):
    def made(a):
        """Null if any argument is null."""
        columns, kind = common(a)
        return Value(F.when(~_any_null(a), build(*columns)), kind)

    return made


SCALAR_EXTREMES = {"MIN": _extreme(F.least), "MAX": _extreme(F.greatest)}


@function("LIKELY", "UNLIKELY", "LIKELIHOOD", least=1, most=2)
def _hint(a):
    return a[0]


@function("TYPEOF")
def _typeof(a):
    name = {INT: "integer", BOOL: "integer", REAL: "real", TEXT: "text", TIME: "text", BLOB: "blob", NULL: "null"}[a[0].kind]
    return Value(F.when(a[0].col.isNull(), "null").otherwise(name), TEXT)


# --- what built-in expressions can't say, in Arrow batches through the standard library's own engine


def _by_engine(name: str, result: str):
    """A function whose formats and modifiers are an interpreter of their own.

    What that engine calls an error is one here: a function it doesn't have when the query is read, malformed JSON
    when the row is met.
    """
    spark_type = {TEXT: "string", INT: "bigint", REAL: "double"}[result]

    def build(a: list[Value]) -> Value:
        call_ = f"SELECT {name}({', '.join('?' * len(a))})"
        given = [v.literal for v in a]
        known = None not in given and not any(isinstance(g, str) and g.lower() == "now" for g in given)
        try:
            # of literals alone the value is known now
            value = sqlite3.connect(":memory:").execute(call_, given if known else [None] * len(a)).fetchone()[0]
        except sqlite3.Error as error:
            if known or "no such function" in str(error):
                raise ValueError(str(error)) from None
        if known:
            return Value(F.lit(value).cast(spark_type), result, literal=value)

        def run(*columns: pd.Series) -> pd.Series:
            engine = sqlite3.connect(":memory:")
            made = {TEXT: str, INT: int, REAL: float}[result]
            found = []
            for row in zip(*columns, strict=True):
                plain = [None if v is None or v != v else v.item() if hasattr(v, "item") else v for v in row]
                value = engine.execute(call_, plain).fetchone()[0]
                found.append(None if value is None else made(value))
            engine.close()
            return pd.Series(found, dtype=object) if result == TEXT else pd.Series(found, dtype="Int64" if result == INT else "float64")

        udf = F.pandas_udf(run, spark_type)
        columns = [v.col if v.kind in (INT, REAL, TEXT) else number(v).col if v.kind == BOOL else text(v) for v in a]
        return Value(udf(*columns), result)

    return build


_PRINTF, _STRFTIME = _by_engine("printf", TEXT), _by_engine("strftime", TEXT)
_ENGINE_DATES = {n: _by_engine(n.lower(), k) for n, k in {"DATE": TEXT, "TIME": TEXT, "DATETIME": TEXT, "JULIANDAY": REAL, "UNIXEPOCH": INT}.items()}
_PLAIN_FORMAT = re.compile(r"%(?:(?P<flags>[-+ 0,]*)(?P<width>[0-9]*)(?P<kind>[di])|(?P<text>s)|%)|[^%]+")  # a text's width counts bytes


@function("PRINTF", "FORMAT", most=_MANY)
def _printf(a):
    """Whole numbers and texts are formatted by built-in expressions if the format is a literal; a null is 0 or empty."""
    form, pieces, args, at = a[0].literal, [], a[1:], 0
    if not isinstance(form, str) or not args or all(v.literal is not None for v in args):
        return _PRINTF(a)
    while at < len(form):
        m = _PLAIN_FORMAT.match(form, at)
        wanted = m and (m["kind"] or m["text"])
        if m is None or wanted and len(pieces) >= len(args):
            return _PRINTF(a)
        if wanted:
            v = args[len(pieces)]
            pieces.append(F.coalesce(integer(v), F.lit(0).cast("bigint")) if m["kind"] else F.coalesce(text(v), F.lit("")))
            if m["kind"] and (re.search(r"(.).*\1|-.*0|0.*-|\+.* | .*\+", m["flags"]) or not m["width"] and re.search("[-0]", m["flags"])):
                return _PRINTF(a)
        at = m.end()
    if len(pieces) != len(args):
        return _PRINTF(a)
    return Value(F.format_string(re.sub(r"%([-+ 0,]*[0-9]*)i", r"%\1d", form.replace("%%", "\0")).replace("\0", "%%"), *pieces), TEXT)


for _name in ("JSON_SET", "JSON_INSERT", "JSON_REPLACE", "JSON_REMOVE", "JSON_PATCH"):
    function(_name, least=2, most=_MANY)(_by_engine(_name.lower(), TEXT))

# --- date and time: one ISO text or stored time without modifiers stays in built-in expressions

_ISO_DATE = r"^-?[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?)?\s*(Z|[+-][0-9]{2}:[0-9]{2})?$"


def _instant(v: Value) -> Column | None:
    """The argument as a UTC time without zone, if built-in expressions can read it."""
    if v.kind == TIME:
        return v.col.cast("timestamp_ntz")
    if v.kind != TEXT or isinstance(v.literal, str) and v.literal.lower() == "now":
        return None
    bare = F.regexp_replace(v.col, r"\s*(Z|[+-][0-9]{2}:[0-9]{2})$", "")
    zone = F.regexp_extract(v.col, r"[0-9]{2}:[0-9]{2}.*([+-][0-9]{2}:[0-9]{2})$", 1)
    minutes = F.when(zone == "", F.lit(0)).otherwise(
        F.concat(F.substring(zone, 1, 1), F.lit("1")).try_cast("int") * (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 5, 2).try_cast("int"))
    )
    return F.when(v.col.rlike(_ISO_DATE), bare.try_cast("timestamp_ntz")) - F.make_dt_interval(mins=minutes)


_MODIFIER = re.compile(r"([+-]?[0-9]{1,6}) (day|hour|minute|second|month|year)s?\Z|start of (day|month|year)\Z")


def _modified(t: Column, modifiers: list[Value]) -> Column | None:
    """A time after literal modifiers, or None if one of them isn't among those that built-in expressions can say.

    Months and years keep the day of the month and run over: a month after 31 January is 2 or 3 March.
    """
    for v in modifiers:
        m = _MODIFIER.match(v.literal.strip().lower()) if isinstance(v.literal, str) else None
        if m is None:
            return None
        day = t.cast("date")
        if m[3]:
            t = (day if m[3] == "day" else F.trunc(day, m[3])).cast("timestamp_ntz")
        elif m[2] in ("month", "year"):
            months = int(m[1]) * (12 if m[2] == "year" else 1)
            moved = F.date_add(F.add_months(F.trunc(day, "month"), months), F.dayofmonth(day) - 1)
            t = moved.cast("timestamp_ntz") + (t - day.cast("timestamp_ntz"))
        else:
            t = t + F.make_dt_interval(**{{"day": "days", "hour": "hours", "minute": "mins", "second": "secs"}[m[2]]: F.lit(int(m[1]))})
    return t


def _dated(name: str, kind: str, build: Callable[[Column], Column]):
    def made(a: list[Value]) -> Value:
        at = _instant(a[0]) if a and not all(v.literal is not None for v in a) else None
        at = at if at is None else _modified(at, a[1:])
        if at is None:
            return _ENGINE_DATES[name]([Value(F.date_format(a[0].col, "yyyy-MM-dd HH:mm:ss.SSS"), TEXT), *a[1:]] if a and a[0].kind == TIME else a)
        return Value(build(at), kind)

    return made


function("DATE", least=0, most=_MANY)(_dated("DATE", TEXT, lambda t: F.date_format(t, "yyyy-MM-dd")))
function("TIME", least=0, most=_MANY)(_dated("TIME", TEXT, lambda t: F.date_format(t, "HH:mm:ss")))
function("DATETIME", least=0, most=_MANY)(_dated("DATETIME", TEXT, lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss")))


def _seconds(t: Column) -> Column:
    day = F.unix_date(t.cast("date")).cast("bigint") * 86_400
    return day + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


function("UNIXEPOCH", least=0, most=_MANY)(_dated("UNIXEPOCH", INT, _seconds))


def _julian_day(t: Column) -> Column:
    """Days from noon of 24 November -4713, by whole milliseconds."""
    near = t + F.make_dt_interval(secs=F.lit(0.0005))
    ms = _seconds(near) * 1000 + F.date_format(near, "SSS").cast("bigint")
    return (ms + F.lit(210_866_760_000_000)) / F.lit(86_400_000.0)


function("JULIANDAY", least=0, most=_MANY)(_dated("JULIANDAY", REAL, _julian_day))


def _months_on(t: Column, months: Column) -> Column:
    """A time some months on with the same day of the month, which runs over into the next month if there is none."""
    day = t.cast("date")
    return F.date_add(F.add_months(F.trunc(day, "month"), months), F.dayofmonth(day) - 1).cast("timestamp_ntz") + (t - day.cast("timestamp_ntz"))


@function("TIMEDIFF", least=2)
def _timediff(a):
    """What to add to the second time to get the first: sign, whole years and months, then days and time of day."""
    read = [_instant(Value(F.lit(v.literal), TEXT) if v.literal is not None else v) for v in a]
    if any(t is None for t in read):
        return _by_engine("timediff", TEXT)(a)
    def steps(v: Column) -> Column:
        one, two = v["one"], v["two"]
        between = (F.year(one) - F.year(two)) * 12 + F.month(one) - F.month(two)
        return F.struct(one.alias("one"), two.alias("two"), (one >= two).alias("up"), between.alias("between"))

    def months(v: Column) -> Column:
        moved = _months_on(v["two"], v["between"])
        short = F.when(v["up"], moved > v["one"]).otherwise(moved < v["one"])
        whole = v["between"] - F.when(short, F.when(v["up"], 1).otherwise(-1)).otherwise(0)
        return F.struct(v["one"].alias("one"), v["two"].alias("two"), v["up"].alias("up"), whole.alias("whole"))

    def rest(v: Column) -> Column:
        return F.struct(v["up"].alias("up"), F.abs(v["whole"]).alias("whole"), (v["one"] - _months_on(v["two"], v["whole"])).alias("rest"))

    def shown(v: Column) -> Column:
        ms, whole = F.abs(_span_ms(v["rest"])), v["whole"]
        parts = [whole / 12, whole % 12, ms / 86_400_000, ms / 3_600_000 % 24, ms / 60_000 % 60, ms / 1000 % 60, ms % 1000]
        return F.format_string("%s%04d-%02d-%02d %02d:%02d:%02d.%03d", F.when(v["up"], "+").otherwise("-"), *(F.floor(x).cast("int") for x in parts))

    # each step is bound to a variable, since written out they would repeat one another many times
    bound = F.array(F.struct(read[0].alias("one"), read[1].alias("two")))
    for step in (steps, months, rest, shown):
        bound = F.transform(bound, step)
    return Value(F.when(read[0].isNotNull() & read[1].isNotNull(), F.element_at(bound, 1)), TEXT)


def _span_ms(span: Column) -> Column:
    """Milliseconds of an interval of days and times."""
    parts = [F.call_function("date_part", F.lit(name), span).cast("double") for name in ("day", "hour", "minute", "second")]
    return F.round(((parts[0] * 24 + parts[1]) * 60 + parts[2]) * 60_000 + parts[3] * 1000).cast("bigint")


# The conversions of STRFTIME that have the same meaning as a pattern of date_format
_FORMATS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD"}


@function("STRFTIME", least=1, most=_MANY)
def _strftime(a):
    form = a[0].literal
    if len(a) >= 2 and isinstance(form, str) and not all(v.literal is not None for v in a):
        parts, at, rest = [], _instant(a[1]), form
        at = at if at is None else _modified(at, a[2:])
        while rest and at is not None:
            if rest[:2] in _FORMATS:
                parts.append(_FORMATS[rest[:2]])
                rest = rest[2:]
            elif rest[0] == "%":
                break
            else:
                parts.append("''" if rest[0] == "'" else f"'{rest[0]}'")
                rest = rest[1:]
        if at is not None and not rest:
            return Value(F.date_format(at, "".join(parts)), TEXT)
    return _STRFTIME([a[0], *(Value(F.date_format(v.col, "yyyy-MM-dd HH:mm:ss.SSS"), TEXT) if v.kind == TIME else v for v in a[1:])])


# --- JSON


def json_piece(v: Value) -> Column:
    """The value as a piece of JSON text."""
    if v.kind == NULL:
        return F.lit("null")
    if v.kind in (TEXT, TIME) and not (v.any_ or v.literal is None and v.affinity == "json"):
        return F.coalesce(F.substring(F.to_json(F.array(text(v))), F.lit(2), F.char_length(F.to_json(F.array(text(v)))) - 2), F.lit("null"))
    return F.coalesce(text(v), F.lit("null"))


@function("JSON_QUOTE")
def _json_quote(a):
    return Value(json_piece(a[0]), TEXT, "json")


@function("JSON_ARRAY", least=0, most=_MANY)
def _json_array(a):
    return Value(F.concat(F.lit("["), F.array_join(F.array(*map(json_piece, a)), ",") if a else F.lit(""), F.lit("]")), TEXT, "json")


@function("JSON_OBJECT", least=0, most=_MANY)
def _json_object(a):
    if len(a) % 2:
        raise ValueError("JSON_OBJECT takes names and values in pairs")
    pairs = [F.concat(json_piece(Value(text(k), TEXT)), F.lit(":"), json_piece(v)) for k, v in zip(a[::2], a[1::2], strict=True)]
    return Value(F.concat(F.lit("{"), F.array_join(F.array(*pairs), ",") if pairs else F.lit(""), F.lit("}")), TEXT, "json")


function("JSON")(_by_engine("json", TEXT))


@function("JSON_VALID")
def _json_valid(a):
    known = F.try_parse_json(text(a[0])).isNotNull()
    return Value(F.when(a[0].col.isNotNull(), known.cast("bigint")), INT)


_STEP = re.compile(r'\.(?:"([^"]*)"|([^.\["]+))|\[([0-9]+)\]|\[#(?:-([0-9]+))?\]')


def _steps(path: str) -> list[str | int]:
    """A path's names and places; a place from the end is negative, and the one after the last is None."""
    found, at = [], 1
    while path.startswith("$") and at < len(path):
        m = _STEP.match(path, at)
        if m is None:
            break
        name = m[1] if m[1] is not None else m[2]
        found.append(name if name is not None else int(m[3]) if m[3] is not None else -int(m[4]) if m[4] else None)
        at = m.end()
    if not path.startswith("$") or at != len(path):
        raise ValueError(f"bad JSON path: {path!r}")
    return found


def _at_path(source: Value, path: str) -> tuple[Column, Column, str | None]:
    """What stands under a path of a JSON text: a struct of its variant ``v`` and its text ``s``, and the path as built-in expressions take it, if they do.

    A malformed text is an error.
    """
    whole = text(source)
    parsed = F.try_parse_json(whole)
    # the parser takes no repeated names, which are well-formed all the same
    value = F.when(parsed.isNotNull() | whole.isNull() | F.get_json_object(whole, "$").isNotNull(), parsed).otherwise(F.raise_error(F.lit("malformed JSON")).cast("variant"))
    own, plain = "$", True
    for step in _steps(path):
        if step is None or isinstance(step, int) and step < 0:
            items = F.try_variant_get(value, own, "array<variant>")
            value, own, plain = F.try_element_at(items, F.lit(step)) if step else F.lit(None).cast("variant"), "$", False
        else:
            mark = '"' if isinstance(step, str) and "'" in step else "'"  # a name has no double quote
            own += f"[{step}]" if isinstance(step, int) else f"[{mark}{step}{mark}]"
            plain = plain and mark == "'"
    value = value if own == "$" else F.try_variant_get(value, own, "variant")
    shown = F.coalesce(F.get_json_object(whole, own), F.to_json(value)) if plain else F.to_json(value)
    return F.struct(value.alias("v"), shown.alias("s")), whole, own if plain else None


def _once(found: Column, build: Callable[[Column], Column]) -> Column:
    """An expression of a value that is worked out once, however often the expression names it."""
    return F.element_at(F.transform(F.array(found), build), 1)


def _json_value(found: Column) -> Column:
    """The dialect's text of a JSON value: true and false are 1 and 0, null is null, fractions have a point."""
    kind, shown = F.schema_of_variant(found["v"]), found["s"]
    real = real_text(F.try_variant_get(found["v"], "$", "double"))
    return (
        F.when(kind == "VOID", None).when(kind == "BOOLEAN", F.when(F.try_variant_get(found["v"], "$", "boolean"), "1").otherwise("0"))
        .when(kind == "STRING", F.try_variant_get(found["v"], "$", "string")).when(kind.rlike("^(DOUBLE|DECIMAL|BIGINT)") & shown.rlike("[.eE]"), real).otherwise(shown)
    )


@function("JSON_EXTRACT", least=2, most=_MANY)
def _json_extract(a):
    """One literal path stays in built-in expressions; several paths give a JSON array. True and false are 1 and 0."""
    if len(a) != 2 or not isinstance(a[1].literal, str):
        return _by_engine("json_extract", TEXT)(a)
    found, whole, path = _at_path(a[0], a[1].literal)
    value = _once(found, _json_value)
    if path is not None:
        # the kind is asked for only where the text leaves it open: no value, a word of JSON, or a number to be written anew
        own = F.get_json_object(whole, path)
        value = F.when(own.isNotNull() & ~own.isin("true", "false", "null") & ~own.rlike(r"^-?[0-9]+[.eE]"), own).otherwise(value)
    return Value(value, TEXT, any_=True)


@function("JSON_TYPE", least=1, most=2)
def _json_type(a):
    if len(a) == 2 and not isinstance(a[1].literal, str):
        return _by_engine("json_type", TEXT)(a)

    def named(found: Column) -> Column:
        kind = F.schema_of_variant(found["v"])
        simple = F.when(kind == "VOID", "null").when(kind == "BOOLEAN", F.try_variant_get(found["v"], "$", "boolean").cast("string")).when(kind == "STRING", "text")
        simple = simple.when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object")
        return simple.when(found["s"].rlike("[.eE]"), "real").when(found["v"].isNotNull(), "integer")

    return Value(_once(_at_path(a[0], a[1].literal if len(a) == 2 else "$")[0], named), TEXT)


@function("JSON_ARRAY_LENGTH", least=1, most=2)
def _json_array_length(a):
    if len(a) == 2 and not isinstance(a[1].literal, str):
        return _by_engine("json_array_length", INT)(a)

    def size(found: Column) -> Column:
        n = F.size(F.try_variant_get(found["v"], "$", "array<variant>"))
        return F.when(found["v"].isNotNull(), F.when(F.schema_of_variant(found["v"]).startswith("ARRAY"), n).otherwise(0).cast("bigint"))

    found, whole, path = _at_path(a[0], a[1].literal if len(a) == 2 else "$")
    value = _once(found, size)
    if path is not None:
        own = F.get_json_object(whole, path)
        value = F.when(own.isNotNull() & ~own.startswith("["), F.lit(0).cast("bigint")).otherwise(value)
    return Value(value, INT)


def json_text(value: object) -> str:
    """Compact JSON with sorted keys, as containers of a record are stored."""
    plain = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return plain.replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")


