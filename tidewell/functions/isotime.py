"""ISO-8601 text to instants, entirely in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HOUR = "([01][0-9]|2[0-3])"
_ZONE = r"(Z|[+-][0-9]{2}(:?[0-5][0-9])?)?"
#: Extended or basic form, date and time parted by `T` or one space, optional fraction, optional zone.
READABLE = (
    r"^([0-9]{4}-[0-9]{2}-[0-9]{2}[T ]" + _HOUR + r":[0-5][0-9]:[0-5][0-9]([.,][0-9]+)?" + _ZONE
    + r"|[0-9]{4}[0-9]{2}[0-9]{2}[T ]" + _HOUR + r"[0-5][0-9][0-5][0-9]([.,][0-9]+)?" + _ZONE + r")\z"
)


def iso_micros(text: Column) -> Column:
    """Microseconds since 1970 UTC of an ISO-8601 text, else null.

    A text without zone means UTC, whatever the session's zone is. Null, blank, partial or
    impossible times (month 13, 30 February, hour 24, an offset beyond 18 hours) give null. Digits
    of the fraction beyond the sixth are cut off.
    """
    extended = F.substring(text, 5, 1) == "-"
    plain = F.when(extended, text).otherwise(
        F.concat(
            F.substring(text, 1, 4), F.lit("-"), F.substring(text, 5, 2), F.lit("-"), F.substring(text, 7, 2), F.lit("T"),
            F.substring(text, 10, 2), F.lit(":"), F.substring(text, 12, 2), F.lit(":"), F.substr(text, F.lit(14)),
        )
    )
    # of a readable text, the last characters tell whether it has a zone: Z, +hh:mm, +hhmm or +hh
    zoned = text.endswith("Z")
    for back in (6, 5, 3):
        zoned = zoned | F.substring(text, -back, 1).isin("+", "-")
    stamped = F.when(zoned, plain).otherwise(F.concat(plain, F.lit("Z")))
    stamped = F.when(text.contains(","), F.replace(stamped, F.lit(","), F.lit("."))).otherwise(stamped)
    return F.when(text.rlike(READABLE), F.unix_micros(stamped.try_cast("timestamp")))


def iso_micros_sql(text: str) -> str:
    """The same as a DuckDB expression, for comparison."""
    shape = READABLE.replace(r"\z", "$").replace("'", "''")
    basic = (
        f"substr({text},1,4)||'-'||substr({text},5,2)||'-'||substr({text},7,2)||'T'||substr({text},10,2)||':'"
        f"||substr({text},12,2)||':'||substr({text},14)"
    )
    plain = f"CASE WHEN substr({text},5,1) = '-' THEN {text} ELSE {basic} END"
    bare = f"replace(regexp_replace({plain}, '(Z|[+-][0-9]{{2}}(:?[0-5][0-9])?)$', '', ''), ',', '.')"
    zone = f"regexp_extract(substr({text},12), '([+-])([0-9]{{2}}):?([0-9]{{2}})?$', ['sign', 'hours', 'minutes'])"
    offset = f"(CASE {zone}.sign WHEN '-' THEN -1 ELSE 1 END * (coalesce(TRY_CAST({zone}.hours AS BIGINT), 0) * 60 + coalesce(TRY_CAST({zone}.minutes AS BIGINT), 0)) * 60000000)"
    return f"(CASE WHEN regexp_matches({text}, '{shape}') THEN epoch_us(TRY_CAST({bare} AS TIMESTAMP)) - {offset} END)"
