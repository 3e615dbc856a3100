"""The dialect's semantics against the standard library's SQLite, on expressions and whole queries."""

import math
import random
import sqlite3

import pytest
from pyspark.sql import types as T

from tidewell.engine import Engine

ROWS = [
    (1, 7, 2.5, "Alpha", "12x", None), (2, -7, -2.5, "beta", "abc", 3), (3, 0, 0.0, "", "-3.5e1", 0), (4, None, 1e6, "été É", " 42 ", -1),
    (5, 100, 0.1, "50%_x", "1", 5), (6, 2, None, None, None, 7), (7, 13, 12.0, "gamma delta", "9.0", 2),
]
SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in (("id", T.LongType()), ("i", T.LongType()), ("r", T.DoubleType()), ("s", T.StringType()), ("d", T.StringType()), ("j", T.LongType()))]
)


@pytest.fixture(scope="module")
def both(spark):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE t (id INTEGER, i INTEGER, r REAL, s TEXT, d TEXT, j INTEGER)")
    db.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?, ?)", ROWS)
    db.execute("CREATE TABLE u (k INTEGER, w TEXT)")
    db.executemany("INSERT INTO u VALUES (?, ?)", [(2, "two"), (7, "seven"), (7, "VII"), (99, "none")])
    engine = Engine(spark).add_frame("t", spark.createDataFrame(ROWS, SCHEMA).cache())
    engine.add_frame("u", spark.createDataFrame([(2, "two"), (7, "seven"), (7, "VII"), (99, "none")], "k bigint, w string").cache())
    return engine, db


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.12g}")
    return v


def same(both, query, ordered=False):
    engine, db = both
    ours = [tuple(map(plain, r)) for r in engine.sql(query).collect()]
    theirs = [tuple(map(plain, r)) for r in db.execute(query.replace("COUNT()", "COUNT(*)")).fetchall()]
    if not ordered:
        ours, theirs = sorted(ours, key=repr), sorted(theirs, key=repr)
    assert ours == theirs, query


EXPRESSIONS = """
i + j | i - r | i * 2 | r * i | i / j | j / i | i / r | r / 0 | i % j | r % 2 | i % 0 | -i / 2 | -7 / 2 | 7 / -2 | -(i + 1) | d + 1 | d * 2 | s + 1
i = 7 | i != 7 | r < i | r >= 2.5 | s = 'beta' | s < 'b' | i = '7' | d = 1 | d > 5 | 1 = '1' | 7 < '5' | r = '2.5' | i = 2.0 | i = 'x' | i < 'x' | d = '1'
i AND j | i OR j | NOT i | NOT r | i > 1 AND s = 'beta' | NULL AND 0 | NULL OR 1 | NOT NULL | i AND NULL
s LIKE 'A%' | s LIKE '%TA' | s LIKE '_eta' | s NOT LIKE 'b%' | s LIKE '50%_x' | i LIKE '1%' | s LIKE NULL | s LIKE d | 'a\\b' LIKE 'A\\_'
i BETWEEN 0 AND 10 | i NOT BETWEEN 0 AND 10 | r BETWEEN i AND j | s BETWEEN 'a' AND 'c' | i IN (7, 2) | i NOT IN (7, NULL) | s IN ('beta', 'x') | i IN (7, 'x') | r IN (2.5, 12)
i IS NULL | s IS NOT NULL | (i > 3) IS NULL | (i > 3) + 1 | (s = 'beta') * 5 | TRUE + 1 | FALSE | NULL | 2.5 | 'it''s'
UPPER(s) | LOWER(s) | LENGTH(s) | LENGTH(i) | LENGTH(r) | SUBSTR(s, 2) | SUBSTR(s, 0, 2) | SUBSTR(s, -3, 2) | SUBSTR(s, 3, -2) | SUBSTR(s, -3) | SUBSTR(s, 2, 100) | SUBSTR(s, -30, 28) | SUBSTR(i, 1, 1)
TRIM(d) | LTRIM(d) | RTRIM(d) | TRIM(s, 'a') | LTRIM(s, 'A5') | RTRIM(s, 'ax') | REPLACE(s, 'a', 'bb') | REPLACE(s, '', 'x') | INSTR(s, 'a') | INSTR(s, '') | HEX(s) | HEX(i) | QUOTE(s) | QUOTE(i) | QUOTE(NULL)
CHAR(72, 233, 8364) | UNICODE(s) | GLOB('*a', s) | GLOB('[a-g]*', s) | LIKE('b%', s) | PRINTF('%05d|%s', i, s) | PRINTF('%.2f', r)
ABS(i) | ABS(r) | ABS(d) | ROUND(r) | ROUND(r, 1) | ROUND(i) | ROUND(2.5) | ROUND(-2.5) | ROUND(r * 1.005, 2) | CEIL(r) | FLOOR(r) | CEIL(i) | TRUNC(r) | SIGN(r) | SIGN(i) | MOD(r, 2)
SQRT(r) | SQRT(i) | POW(i, 2) | POWER(2, r) | EXP(0.5) | LN(r) | LOG(r) | LOG(2, 8) | LOG10(i) | LOG2(i) | SIN(r) | COS(i) | ATAN2(r, i) | DEGREES(r) | RADIANS(i) | PI() | ASIN(i) | ACOSH(i) | TANH(r)
COALESCE(i, j, 0) | IFNULL(s, 'none') | NULLIF(i, 7) | NULLIF(s, 'beta') | IIF(i > 1, 'y', 'n') | MIN(i, j) | MAX(i, j, 3) | MAX(i, r) | MIN(s, 'c') | MAX(i, NULL) | TYPEOF(i) | TYPEOF(r) | TYPEOF(s) | TYPEOF(i > 1) | LIKELY(i)
DATE('2024-01-31', '+1 month') | DATE('2024-02-29 23:59:59') | TIME('2024-02-29 23:59:59') | DATETIME('2024-02-29T23:59:59Z') | STRFTIME('%Y/%m/%d %H', '2024-02-29 23:59:59') | UNIXEPOCH('2024-02-29') | JULIANDAY('2024-02-29') | DATE('x') | DATE('2024-03-10', 'start of month', '-1 day') | DATETIME('2024-02-29T23:59:59+02:00') | STRFTIME('%j %w', '2024-02-29')
JSON_VALID('{"a":1}') | JSON_VALID('{a') | JSON_ARRAY(i, s, 1.5, NULL) | JSON_OBJECT('k', s, 'n', i) | JSON_ARRAY_LENGTH('[1,2,3]') | JSON_EXTRACT('{"a":{"b":"x"}}', '$.a.b') | JSON_EXTRACT('{"a":5}', '$.a') + 1 | JSON_SET('{"a":1}', '$.b', 2) | JSON_QUOTE(s) | JSON_TYPE('[1]') | JSON_REMOVE('{"a":1,"b":2}', '$.a')
"""
#: Not in every build of SQLite.
OPTIONAL = {"UNIXEPOCH", "LOG", "SIGN", "TRUNC"}


def has(db, expression):
    try:
        db.execute(f"SELECT {expression} FROM t").fetchall()
        return True
    except sqlite3.OperationalError:
        return False


@pytest.mark.parametrize("line", EXPRESSIONS.strip().splitlines())
def test_expressions(both, line):
    parts = [e.strip() for e in line.split(" | ") if has(both[1], e)]
    assert parts
    same(both, "SELECT id, " + ", ".join(f"{e} AS c{k}" for k, e in enumerate(parts)) + " FROM t")


DATES = [(1, "2024-01-31"), (2, "2024-02-29 23:59:59"), (3, "1969-12-31T00:00:01Z"), (4, "x"), (5, None), (6, "2023-12-31 12:30"), (7, "2024-03-10 01:02:03.5"), (8, "2024-02-29T23:59:59+02:00")]


def test_date_columns(spark):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE t (id INTEGER, d TEXT)")
    db.executemany("INSERT INTO t VALUES (?, ?)", DATES)
    engine = Engine(spark).add_frame("t", spark.createDataFrame(DATES, "id bigint, d string"))
    moves = ["", ", '+1 month'", ", '-13 months'", ", '+1 year'", ", 'start of month', '-1 day'", ", 'start of year'", ", '+36 hours', '+90 minutes'", ", '-5 seconds', 'start of day'", ", '+1.5 days'", ", 'weekday 1'"]
    forms = ["DATE(d{})", "DATETIME(d{})", "TIME(d{})", "STRFTIME('%Y|%m/%d %H:%M:%S %j', d{})", "STRFTIME('%w %s', d{})", "JULIANDAY(d{})", "UNIXEPOCH(d{})"]
    parts = [f.format(m) for f in forms for m in moves if has(db, f.format(m))]
    same((engine, db), "SELECT id, " + ", ".join(f"{e} AS c{k}" for k, e in enumerate(parts)) + " FROM t")


QUERIES = [
    "SELECT COUNT(*) AS n, COUNT(i) AS c, SUM(i) AS s, AVG(i) AS a, MIN(r) AS lo, MAX(s) AS hi, TOTAL(i) AS t, SUM(d) AS x FROM t",
    "SELECT COUNT() AS n FROM t WHERE i > 1000",
    "SELECT SUM(i) AS s, TOTAL(i) AS t, MAX(i) AS m, GROUP_CONCAT(s) AS g FROM t WHERE i > 1000",
    "SELECT i % 2 AS odd, COUNT(*) AS n FROM t GROUP BY odd",
    "SELECT i > 5 AS big, SUM(r) AS s FROM t GROUP BY 1",
    "SELECT i > 5 AS big, SUM(r) + COUNT(*) AS s FROM t GROUP BY i > 5 ORDER BY COUNT(*), big",
    "SELECT s, MAX(i) AS m FROM t",
    "SELECT id, s, MIN(r) AS m FROM t WHERE r IS NOT NULL GROUP BY i > 5",
    "SELECT DISTINCT i > 5 AS b FROM t",
    "SELECT DISTINCT j % 2 AS p FROM t WHERE p IS NOT NULL",
    "SELECT t.id AS a, u.w AS b FROM t JOIN u ON t.i = u.k",
    "SELECT t.id AS a, u.w AS b FROM t LEFT JOIN u ON t.i = u.k AND u.w != 'VII'",
    "SELECT t.id AS a, u.w AS b FROM t RIGHT JOIN u ON t.i = u.k",
    "SELECT t.id AS a, u.w AS b FROM t JOIN u ON t.i < u.k AND t.j > 1",
    "SELECT a.id AS x, b.id AS y FROM t a JOIN t b ON a.i = b.i + 6 OR a.id = b.j",
    "SELECT t.id AS a FROM t LEFT JOIN u ON t.i = u.k WHERE u.k IS NULL",
    "SELECT id AS i2, i AS v FROM t WHERE v > 5",
    "SELECT i FROM t WHERE i",
    "SELECT i FROM t WHERE s",
    "SELECT 1 + 1 AS a, 'x' AS b",
    "SELECT COUNT(*) AS n FROM t LEFT JOIN u ON t.i = u.k WHERE NOT u.k IS NULL",
]
ORDERED = [
    "SELECT id, i FROM t ORDER BY i, id", "SELECT id, i FROM t ORDER BY i DESC, id DESC", "SELECT id FROM t ORDER BY s LIMIT 3", "SELECT id, -i AS i FROM t ORDER BY i, id",
    "SELECT id, s FROM t ORDER BY 2 DESC LIMIT 4", "SELECT id FROM t ORDER BY LENGTH(s), id", "SELECT DISTINCT i FROM t ORDER BY id", "SELECT id FROM t ORDER BY id LIMIT 0",
    "SELECT id FROM t ORDER BY id LIMIT -1", "SELECT i > 5 AS b, COUNT(*) AS n FROM t GROUP BY b ORDER BY n DESC, b",
]


@pytest.mark.parametrize("query", QUERIES)
def test_queries(both, query):
    same(both, query)


@pytest.mark.parametrize("query", ORDERED)
def test_ordered_queries(both, query):
    same(both, query, ordered=True)


def test_random_expressions(both):
    rng = random.Random(7)

    def tree(depth):
        if depth == 0:
            return rng.choice(["i", "j", "r", "1", "2.5", "-3", "NULL", "0", "id"])
        a, b = tree(depth - 1), tree(depth - 1)
        form = rng.choice(["({a} + {b})", "({a} - {b})", "({a} * {b})", "({a} / {b})", "({a} % {b})", "({a} < {b})", "({a} = {b})", "({a} AND {b})", "({a} OR {b})", "(NOT {a})",
            "({a} BETWEEN {b} AND 5)", "({a} IN ({b}, 2))", "({a} IS NULL)", "COALESCE({a}, {b})", "ABS({a})", "MAX({a}, {b})", "IIF({a}, {b}, {a})"])
        return form.format(a=a, b=b)

    made = [tree(rng.choice([1, 2, 3])) for _ in range(60)]
    for low in range(0, len(made), 30):
        same(both, "SELECT id, " + ", ".join(f"{e} AS c{k}" for k, e in enumerate(made[low : low + 30])) + " FROM t")
