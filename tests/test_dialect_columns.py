"""Functions over columns rather than constants, against the standard library's SQLite or a reckoning of their own."""

import datetime
import json
import random
import sqlite3

import pytest
from test_differential import plain, same

from tidewell.engine import Engine
from tidewell.plans.dialect import QueryError

DOCS = [
    (1, '{"a":"true","b":true,"c":null,"d":[1,2,{"e":"x"}]}'), (2, '{"a":"false","b":false,"c":"null","d":[]}'), (3, '{"a":"null","b":1.50,"c":1e3,"d":7}'),
    (4, '{"a":9223372036854775807,"b":-0.5,"c":"5","d":["é",[0,[9]]]}'), (5, None), (6, '[5,6]'), (7, '"s"'), (8, '{"a b":1,"a.b":2,"q\'":3}'), (9, "null"), (10, "12"), (11, '{"d":{"z":1,"b":[2, 3]}}'),
]
PATHS = ["$", "$.a", "$.b", "$.c", "$.d", "$.d[0]", "$.d[#-1]", "$.d[#-2]", "$.d[1][1][0]", "$.d[2].e", "$[1]", "$[#-1]", '$."a b"', '$."a.b"', "$.q'", "$.d[9]", "$.none.x", "$.d[#]"]


@pytest.fixture(scope="module")
def docs(spark):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE t (id INTEGER, j TEXT)")
    db.executemany("INSERT INTO t VALUES (?, ?)", DOCS)
    return Engine(spark).add_frame("t", spark.createDataFrame(DOCS, "id bigint, j string").cache()), db


def shown(v):
    if isinstance(v, str) and v[:1] in ("{", "["):
        return json.loads(v)  # numbers inside containers may be written otherwise
    return v if v is None or isinstance(v, str) else repr(v)


@pytest.mark.parametrize("path", PATHS)
def test_json_values_keep_their_kind(docs, path):
    engine, db = docs
    quoted = path.replace("'", "''")
    query = f"SELECT id, JSON_EXTRACT(j, '{quoted}') AS v, JSON_TYPE(j, '{quoted}') AS k, JSON_ARRAY_LENGTH(j, '{quoted}') AS n FROM t ORDER BY id"
    ours = [(i, shown(v), k, n) for i, v, k, n in engine.sql(query).collect()]
    # a column has one type, so extracted numbers are texts
    assert ours == [(i, shown(v), k, n) for i, v, k, n in db.execute(query).fetchall()]


def test_json_errors(spark, docs):
    engine = Engine(spark).add_frame("t", spark.createDataFrame([(1, '{"a":1}'), (2, "{bad")], "id bigint, j string"))
    for call in ("JSON_EXTRACT(j, '$.a')", "JSON_SET(j, '$.a', 1)", "JSON_TYPE(j)"):
        with pytest.raises(Exception, match="malformed JSON"):
            engine.sql(f"SELECT {call} AS v FROM t").collect()
    assert [r[0] for r in engine.sql("SELECT JSON_VALID(j) AS v FROM t ORDER BY id").collect()] == [1, 0]
    with pytest.raises(QueryError, match="path"):
        docs[0].sql("SELECT JSON_EXTRACT(j, 'a') AS v FROM t")
    twice = Engine(spark).add_frame("t", spark.createDataFrame([('{"a":"x","a":"y"}',)], "j string"))
    assert twice.sql("SELECT JSON_EXTRACT(j, '$') IS NOT NULL AS v FROM t").first()[0] == 1


ROWS = [
    (1, 2**63 - 1, 3, "abc", "2024-02-29 23:59:59", "a*"), (2, -(2**63), -1, "", "1969-12-31T00:00:01Z", "*"), (3, 5, 0, "  x ", "2024-03-10 01:02:03.5", "[b-d]?"),
    (4, None, None, None, None, None), (5, -42, 12, "Tymczak", "2023-12-31 12:30", "x"), (6, 100000, 7, "éa'b", "0001-01-01", ""),
]


@pytest.fixture(scope="module")
def both(spark):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE t (id INTEGER, big INTEGER, i INTEGER, s TEXT, d TEXT, p TEXT)")
    db.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?, ?)", ROWS)
    return Engine(spark).add_frame("t", spark.createDataFrame(ROWS, "id bigint, big bigint, i bigint, s string, d string, p string").cache()), db


@pytest.mark.parametrize(
    "line",
    [
        "PRINTF('%05d|%-6d|%+d|%d%%', big, i, i, i) | PRINTF('%s-%10s|%-10s|%.2s', s, s, s, s) | PRINTF('%d %s', i, big) | PRINTF('%i', s) | PRINTF('%x %c', i, s) | PRINTF('%5.1f', i)",
        "TRIM(s) | LTRIM(s) | RTRIM(s) | TRIM(s, 'ab') | HEX(s) | HEX(i) | UPPER(s) | QUOTE(s) | UNICODE(s) | INSTR(s, 'b')",
        "JULIANDAY(d) | TIME(d) | DATETIME(d) | DATE(d, '-1 month') | GLOB(p, s) | GLOB('*a*', s) | LIKE(p, s) | LIKELY(i) | IIF(i, s, d)",
        "MAX(big, i) | MIN(big, i) | COALESCE(big, i) | IFNULL(i, big) | big % 10 | big / 7 | i / -1 | big = i | big > i | -i",
        "JSON_QUOTE(s) | JSON_ARRAY(s, i, big) | JSON_OBJECT('k', s) | JSON_SET('{}', '$.v', s) | JSON_INSERT('{\"v\":1}', '$.w', i) | JSON_PATCH('{\"a\":1}', '{\"a\":null}') | JSON_REMOVE('[1,2]', '$[0]')",
    ],
)
def test_columns(both, line):
    parts = line.split(" | ")
    same(both, "SELECT id, " + ", ".join(f"{e} AS c{k}" for k, e in enumerate(parts)) + " FROM t")


def test_separators_by_row(both):
    engine, _ = both
    rows = [("x", "b", "-"), ("x", "a", "+"), ("x", None, "*"), ("y", "c", None), ("y", "d", None), ("z", None, ",")]
    got = Engine(engine.spark).add_frame("t", engine.spark.createDataFrame(rows, "g string, s string, p string")).sql("SELECT g, GROUP_CONCAT(s, p) AS c FROM t GROUP BY g ORDER BY g")
    assert [tuple(r) for r in got.collect()] == [("x", "a-b"), ("y", "cd"), ("z", None)]


def test_whole_numbers_that_outgrow_64_bits_are_null(both):
    got = both[0].sql("SELECT big + 1 AS a, big * 2 AS b, big - 1 AS c, -big AS d, big / -1 AS e FROM t WHERE id < 3 ORDER BY id").collect()
    assert [tuple(r) for r in got] == [(None, None, 2**63 - 2, -(2**63 - 1), -(2**63 - 1)), (-(2**63) + 1, None, None, None, None)]


def test_substr_takes_any_whole_numbers(both):
    got = both[0].sql("SELECT SUBSTR(s, 1, 9223372036854775807) AS a, SUBSTR(s, -9223372036854775807, 9223372036854775807) AS b, SUBSTR(s, big) AS c, SUBSTR(s, 2, big) AS d FROM t WHERE id = 1")
    assert got.first()[:] == ("abc", "abc", "", "bc")


def test_soundex_hex_and_random(both):
    got = {r["s"]: r["x"] for r in both[0].sql("SELECT s, SOUNDEX(s) AS x FROM t WHERE s IS NOT NULL").collect()}
    assert got["abc"] == "A120" and got["Tymczak"] == "T522" and got[""] == "?000"
    assert both[0].sql("SELECT OCTET_LENGTH(s) AS n, HEX(ZEROBLOB(2)) AS z, HEX(UNHEX('0aFF')) AS h FROM t WHERE id = 6").first()[:] == (5, "0000", "0AFF")
    assert both[0].sql("SELECT RANDOM() AS r FROM t").distinct().count() == len(ROWS)


def moved(t, months):
    y, m = divmod(t.year * 12 + t.month - 1 + months, 12)
    return datetime.datetime(y, m + 1, 1, t.hour, t.minute, t.second, t.microsecond) + datetime.timedelta(days=t.day - 1)


def reckoned(a, b):
    """The largest number of whole months from ``b`` that doesn't pass ``a``, and the rest."""
    sign, step = ("+", 1) if a >= b else ("-", -1)
    months = 0
    while (moved(b, (months + 1) * step) <= a) if step > 0 else (moved(b, (months + 1) * step) >= a):
        months += 1
    rest = abs(a - moved(b, months * step))
    seconds = rest.seconds
    return f"{sign}{months // 12:04d}-{months % 12:02d}-{rest.days:02d} {seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}.{rest.microseconds // 1000:03d}"


def test_timediff(spark):
    rng = random.Random(2)

    def moment():
        y, m = rng.randint(1998, 2004), rng.randint(1, 12)
        return datetime.datetime(y, m, rng.choice([1, 15, 28]), rng.randint(0, 23), rng.randint(0, 59), rng.randint(0, 59), rng.choice([0, 250_000]))

    pairs = [(k, moment(), moment()) for k in range(300)]
    pairs.append((300, pairs[0][1], pairs[0][1]))
    rows = [(k, str(a), str(b)) for k, a, b in pairs] + [(301, "x", "2000-01-01"), (302, None, "2000-01-01")]
    engine = Engine(spark).add_frame("t", spark.createDataFrame(rows, "id bigint, a string, b string"))
    got = {r["id"]: r["x"] for r in engine.sql("SELECT id, TIMEDIFF(a, b) AS x FROM t").collect()}
    assert got[301] is None and got[302] is None and got[300] == "+0000-00-00 00:00:00.000"
    wrong = [(a, b, got[k], reckoned(a, b)) for k, a, b in pairs if got[k] != reckoned(a, b)]
    assert not wrong, wrong[:5]
    assert engine.sql("SELECT TIMEDIFF('2023-02-15', '2023-03-15') AS x").first()[0] == "-0000-01-00 00:00:00.000"


def test_unknown_functions_are_told(spark):
    for call in ("JSON_PRETTY('{}')", "NOSUCH(1)"):
        try:
            sqlite3.connect(":memory:").execute(f"SELECT {call}")
        except sqlite3.Error:
            with pytest.raises(QueryError, match="no such function"):
                Engine(spark).sql(f"SELECT {call} AS x")
    assert plain(1.0) == 1.0
