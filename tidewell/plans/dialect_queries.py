"""Queries in the dialect over the test tables, one for each operator, with DuckDB SQL to compare against."""

from __future__ import annotations

import io
import json
import os
import sqlite3
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.engine import Engine, stream
from tidewell.plans.dialect import parse_one
from tidewell.plans.lowering import SNAPSHOT
from tidewell.runtime import micros, scratch_path
from tidewell.streaming.requery import replay

#: name: query in the dialect, the same in DuckDB's (None where the text is the same)
BATCH: dict[str, tuple[str, str | None]] = {
    # projection and filters
    "scan_star": ("SELECT * FROM nation", None),
    "qualified_star": ("SELECT n.* FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'ASIA'", None),
    "project_alias": ("SELECT p_partkey AS k, p_name name, p_retailprice * 2 AS twice FROM part", None),
    "distinct": ("SELECT DISTINCT p_brand, p_size FROM part", None),
    "filter_cmp": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 250000 AND o_orderstatus != 'F'", None),
    "filter_and_or_not": (
        "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'O' OR o_totalprice < 100000) AND (o_orderpriority = '1-URGENT' OR o_custkey < 500)", None),
    "filter_time": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate >= '1997-01-01' AND l_shipdate < '1997-02-01'", None),
    "between": ("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20", None),
    "not_between": ("SELECT p_partkey FROM part WHERE p_retailprice NOT BETWEEN 950 AND 1500.5", None),
    "in_list": ("SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 5, 9) AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13')", None),
    "not_in": ("SELECT event_id FROM events WHERE event_type NOT IN ('view', 'click')", None),
    "like_ci": ("SELECT c_custkey FROM customer WHERE c_mktsegment LIKE 'b%LD_NG'", "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'b%LD_NG'"),
    "not_like": ("SELECT p_partkey FROM part WHERE p_type NOT LIKE '%st%'", "SELECT p_partkey FROM part WHERE p_type NOT ILIKE '%st%'"),
    "is_null": ("SELECT doc_id FROM documents WHERE text IS NULL OR lang IS NULL", None),
    "is_not_null": ("SELECT doc_id, votes FROM documents WHERE votes IS NOT NULL AND title IS NULL", None),
    "literals": ("SELECT n_name, 1 AS one, 2.5 AS x, 'it''s' AS s, TRUE AS t, FALSE AS f, NULL AS nothing FROM nation",
        "SELECT n_name, 1 AS one, 2.5::DOUBLE AS x, 'it''s' AS s, 1 AS t, 0 AS f, NULL::VARCHAR AS nothing FROM nation"),
    "no_from": ("SELECT 1 + 1 AS two, 7 / 2 AS three, UPPER('a') AS a", "SELECT 2 AS two, 3 AS three, 'A' AS a"),
    "comments": ("SELECT n_name -- the name\nFROM nation -- all\nWHERE n_nationkey < 5", None),
    # arithmetic and truth
    "arith": ("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem", None),
    "precedence": ("SELECT p_partkey, 1 + p_size * 2 - 3 AS a, NOT p_size = 1 AND p_size > 5 OR p_size = 3 AS b FROM part",
        "SELECT p_partkey, 1 + p_size * 2 - 3 AS a, CAST((NOT p_size = 1 AND p_size > 5 OR p_size = 3) AS BIGINT) AS b FROM part"),
    "int_div": ("SELECT p_partkey, p_size / 7 AS q, -p_size / 7 AS nq, p_retailprice / 7 AS r FROM part",
        "SELECT p_partkey, p_size // 7 AS q, -p_size // 7 AS nq, p_retailprice / 7 AS r FROM part"),
    "modulo": ("SELECT p_partkey, p_size % 7 AS m, p_retailprice % 7 AS rm FROM part",
        "SELECT p_partkey, p_size % 7 AS m, CAST(trunc(p_retailprice) AS BIGINT) % 7 AS rm FROM part"),
    "unary_minus": ("SELECT c_custkey, -c_acctbal AS owed FROM customer WHERE c_acctbal < -1 AND -c_acctbal > 500", None),
    "div_by_zero": ("SELECT p_partkey, 5 / (p_size - 1) AS a, 5 % (p_size - 1) AS b, p_retailprice / 0 AS c FROM part",
        "SELECT p_partkey, CASE WHEN p_size <> 1 THEN 5 // (p_size - 1) END AS a, CASE WHEN p_size <> 1 THEN 5 % (p_size - 1) END AS b, NULL::DOUBLE AS c FROM part"),
    "truthiness": ("SELECT p_partkey, p_size > 10 AS big FROM part WHERE p_size % 2", "SELECT p_partkey, CAST(p_size > 10 AS BIGINT) AS big FROM part WHERE p_size % 2 <> 0"),
    "text_number": ("SELECT p_partkey, p_brand > 5 AS t, 7 < '5' AS u, p_size = '7' AS v FROM part",
        "SELECT p_partkey, 1 AS t, 1 AS u, CAST(p_size = 7 AS BIGINT) AS v FROM part"),
    "text_arith": ("SELECT o_orderkey, o_orderpriority * 2 AS n FROM orders",
        "SELECT o_orderkey, CAST(left(o_orderpriority, 1) AS DOUBLE) * 2 AS n FROM orders"),
    # joins
    "join_inner": ("SELECT c_name, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000", None),
    "join_left": ("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 280000", None),
    "join_right": ("SELECT c.c_custkey, o.o_orderkey FROM orders o RIGHT JOIN customer c ON c.c_custkey = o.o_custkey AND o.o_totalprice > 280000", None),
    "join_theta": ("SELECT a.n_name AS low, b.n_name AS high FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "join_range": ("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey BETWEEN n_nationkey AND n_nationkey + 1", None),
    "join_self": ("SELECT a.c_custkey AS x, b.c_custkey AS y FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey = b.c_custkey + 25", None),
    "join_3way": (
        "SELECT r.r_name AS region, COUNT(*) AS n, SUM(o.o_totalprice) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation k ON c.c_nationkey = k.n_nationkey JOIN region r ON k.n_regionkey = r.r_regionkey GROUP BY r.r_name", None),
    "anti_via_left": ("SELECT p.p_partkey FROM part p LEFT JOIN lineitem l ON p.p_partkey = l.l_partkey AND l.l_quantity > 49 WHERE l.l_partkey IS NULL", None),
    "join_mixed_keys": ("SELECT u.user_id, c.c_name FROM user_events u JOIN customer c ON u.user_id = c.c_custkey", None),
    # aggregates
    "agg_global": ("SELECT COUNT(*) AS n, SUM(l_quantity) AS q, MIN(l_tax) AS lo, MAX(l_extendedprice) AS hi, AVG(l_discount) AS d FROM lineitem", None),
    "agg_group": ("SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS q, AVG(l_extendedprice) AS p, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "agg_expr_group": ("SELECT p_size / 10 AS bucket, COUNT(*) AS n FROM part GROUP BY p_size / 10", "SELECT p_size // 10 AS bucket, count(*) AS n FROM part GROUP BY ALL"),
    "group_ordinal_alias": ("SELECT o_orderstatus AS s, o_orderpriority, SUM(o_totalprice) AS t FROM orders GROUP BY s, 2", None),
    "count_col": ("SELECT lang, COUNT(votes) AS v, COUNT(*) AS n, COUNT(text) AS t FROM documents GROUP BY lang", None),
    "agg_empty": ("SELECT COUNT(*) AS n, SUM(p_size) AS s, TOTAL(p_size) AS t, MAX(p_name) AS m FROM part WHERE p_size < 0",
        "SELECT 0 AS n, NULL::BIGINT AS s, 0.0::DOUBLE AS t, NULL::VARCHAR AS m"),
    "agg_in_expr": ("SELECT l_returnflag, SUM(l_extendedprice) / COUNT(*) + 1 AS a FROM lineitem GROUP BY l_returnflag ORDER BY MAX(l_tax), COUNT(*)", None),
    "group_concat": ("SELECT r_name, GROUP_CONCAT(n_name, '; ') AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
        "SELECT r_name, string_agg(n_name, '; ' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
    "total": ("SELECT c_mktsegment, TOTAL(c_acctbal) AS t FROM customer GROUP BY c_mktsegment", "SELECT c_mktsegment, sum(c_acctbal) AS t FROM customer GROUP BY c_mktsegment"),
    "json_group": ("SELECT n_regionkey, JSON_GROUP_ARRAY(n_nationkey) AS a FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, '[' || string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey::VARCHAR) || ']' AS a FROM nation GROUP BY n_regionkey"),
    "scalar_min_max": ("SELECT p_partkey, MIN(p_size, 10) AS lo, MAX(p_size, 10.5) AS hi, MAX(p_size, NULL) AS nothing FROM part",
        "SELECT p_partkey, least(p_size, 10) AS lo, greatest(p_size::DOUBLE, 10.5) AS hi, NULL::BIGINT AS nothing FROM part"),
    "bare_column_max": ("SELECT o_custkey, o_orderkey, MAX(o_totalprice) AS top FROM orders GROUP BY o_custkey",
        "SELECT o_custkey, arg_max(o_orderkey, o_totalprice) AS o_orderkey, max(o_totalprice) AS top FROM orders GROUP BY o_custkey"),
    # order and limit
    "orderby_limit_topk": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", None),
    "order_by_alias": ("SELECT p_partkey, -p_retailprice AS worth FROM part ORDER BY worth, p_partkey LIMIT 25", None),
    "order_by_hidden": ("SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20", None),
    "order_by_ordinal": ("SELECT s_name, s_acctbal FROM supplier ORDER BY 2 DESC, 1 LIMIT 7", None),
    "order_nulls": ("SELECT doc_id, votes FROM documents ORDER BY votes, doc_id LIMIT 30", "SELECT doc_id, votes FROM documents ORDER BY votes NULLS FIRST, doc_id LIMIT 30"),
    "distinct_order_hidden": ("SELECT DISTINCT p_brand FROM part ORDER BY p_size, p_brand LIMIT 3",
        "SELECT p_brand FROM part GROUP BY p_brand ORDER BY min(p_size), min(p_brand) LIMIT 3"),
    "limit_negative": ("SELECT r_name FROM region LIMIT -1", "SELECT r_name FROM region"),
    "every_without_over": ("SELECT r_name FROM region EVERY 5s", "SELECT r_name FROM region"),
    "alias_in_where": ("SELECT p_partkey, p_retailprice * 2 AS twice FROM part WHERE twice > 1800", "SELECT p_partkey, p_retailprice * 2 AS twice FROM part WHERE p_retailprice * 2 > 1800"),
    "duplicate_names": ("SELECT n_nationkey AS k, n_name AS k, n_regionkey FROM nation", "SELECT n_name AS k, n_regionkey FROM nation"),
    # functions
    "fn_string": (
        "SELECT p_partkey, UPPER(p_name) AS u, LOWER(p_type) AS l, LENGTH(p_name) AS n, SUBSTR(p_name, 2, 3) AS s, SUBSTR(p_name, -3) AS e, SUBSTR(p_name, 0, 3) AS z, TRIM('  x ') AS t, LTRIM('xxy', 'x') AS lt, RTRIM('yxx', 'x') AS rt, REPLACE(p_brand, '#', '-') AS r, INSTR(p_brand, '#') AS i, HEX('ab') AS h, CONCAT(p_brand, NULL, p_size) AS c FROM part",
        "SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l, length(p_name) AS n, substr(p_name, 2, 3) AS s, substr(p_name, -3) AS e, substr(p_name, 1, 2) AS z, 'x' AS t, 'y' AS lt, 'y' AS rt, replace(p_brand, '#', '-') AS r, instr(p_brand, '#') AS i, '6162' AS h, concat(p_brand, p_size) AS c FROM part"),
    "fn_math": (
        "SELECT p_partkey, ABS(-p_size) AS a, ROUND(p_retailprice, 1) AS r, CEIL(p_retailprice) AS c, FLOOR(-p_retailprice) AS f, SQRT(p_size) AS q, POWER(p_size, 2) AS p, LN(p_size) AS ln, LOG(p_size) AS lg, EXP(1.0) AS e, SIGN(p_size - 10) AS s, MOD(p_retailprice, 7) AS m, SQRT(-1.0) AS nothing, TRUNC(-2.5) AS t FROM part",
        "SELECT p_partkey, abs(p_size) AS a, round(p_retailprice, 1) AS r, ceil(p_retailprice) AS c, floor(-p_retailprice) AS f, sqrt(p_size) AS q, power(p_size, 2) AS p, ln(p_size) AS ln, log10(p_size) AS lg, exp(1.0) AS e, sign(p_size - 10) AS s, fmod(p_retailprice, 7) AS m, NULL::DOUBLE AS nothing, -2.0::DOUBLE AS t FROM part"),
    "fn_null": ("SELECT doc_id, COALESCE(title, lang, '-') AS a, IFNULL(votes, -1) AS b, NULLIF(lang, 'en') AS c, IIF(votes > 3, 'hi', 'lo') AS d, TYPEOF(votes) AS t FROM documents",
        "SELECT doc_id, coalesce(title, lang, '-') AS a, ifnull(votes, -1) AS b, nullif(lang, 'en') AS c, CASE WHEN votes > 3 THEN 'hi' ELSE 'lo' END AS d, CASE WHEN votes IS NULL THEN 'null' ELSE 'integer' END AS t FROM documents"),
    "fn_date": (
        "SELECT o_orderkey, DATE(o_orderdate) AS d, STRFTIME('%Y-%m', o_orderdate) AS ym, UNIXEPOCH(o_orderdate) AS e, DATE('2024-01-31', '+1 month') AS over FROM orders",
        "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%Y-%m') AS ym, CAST(epoch(o_orderdate) AS BIGINT) AS e, '2024-03-02' AS over FROM orders"),
    "fn_json": ("SELECT event_id, JSON_VALID(props) AS ok, JSON_ARRAY(event_type, user_id) AS a, JSON_OBJECT('u', user_id) AS o FROM events",
        "SELECT event_id, 1 AS ok, '[\"' || event_type || '\",' || user_id || ']' AS a, '{\"u\":' || user_id || '}' AS o FROM events"),
    "fn_date_modifiers": ("SELECT o_orderkey, DATE(o_orderdate, '+7 days') AS d, DATE(o_orderdate, 'start of month') AS m, PRINTF('%05d', o_custkey) AS p FROM orders",
        "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 7 DAY, '%Y-%m-%d') AS d, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS m, printf('%05d', o_custkey) AS p FROM orders"),
    "fn_json_extract": ("SELECT event_id, JSON_EXTRACT(props, '$.k') + 1 AS next, JSON_EXTRACT(props, '$.k') > 50 AS big, JSON_EXTRACT(props, '$.none') IS NULL AS none FROM events",
        "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) + 1 AS next, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) > 50 AS BIGINT) AS big, 1 AS none FROM events"),
    "fn_text_more": ("SELECT n_nationkey, UNICODE(n_name) AS u, CHAR(65, 233) AS c, GLOB('[A-F]*', n_name) AS g, QUOTE(n_name) AS q, CONCAT_WS('-', n_name, NULL, n_regionkey) AS w, SUBSTR(n_name, -4, 2) AS s FROM nation",
        "SELECT n_nationkey, unicode(n_name) AS u, 'Aé' AS c, CAST((n_name[1] BETWEEN 'A' AND 'F') AS BIGINT) AS g, chr(39) || n_name || chr(39) AS q, n_name || '-' || n_regionkey AS w, CASE WHEN length(n_name) >= 4 THEN substr(n_name, -4, 2) ELSE NULL END AS s FROM nation"),
    "fn_trig": ("SELECT c_custkey, ROUND(SIN(c_acctbal), 9) AS s, ROUND(COS(c_acctbal), 9) AS c, ROUND(ATAN(c_acctbal), 9) AS a, ROUND(ATAN2(c_acctbal, 10), 9) AS b, ROUND(TANH(c_acctbal / 5000), 9) AS h, ROUND(DEGREES(c_acctbal), 6) AS d, ROUND(RADIANS(c_acctbal), 9) AS r, ROUND(PI(), 9) AS p FROM customer",
        "SELECT c_custkey, round(sin(c_acctbal), 9) AS s, round(cos(c_acctbal), 9) AS c, round(atan(c_acctbal), 9) AS a, round(atan2(c_acctbal, 10), 9) AS b, round(tanh(c_acctbal / 5000), 9) AS h, round(degrees(c_acctbal), 6) AS d, round(radians(c_acctbal), 9) AS r, round(pi(), 9) AS p FROM customer"),
    "fn_text_columns": ("SELECT p_partkey, TRIM(p_type, 'ESD ') AS t, LTRIM(p_brand, 'Brand#') AS l, RTRIM(p_brand, '12345') AS r, HEX(p_brand) AS h, HEX(UNHEX(HEX(p_name))) AS u, OCTET_LENGTH(p_name) AS o FROM part",
        "SELECT p_partkey, trim(p_type, 'ESD ') AS t, ltrim(p_brand, 'Brand#') AS l, rtrim(p_brand, '12345') AS r, hex(p_brand) AS h, hex(p_name) AS u, strlen(p_name) AS o FROM part"),
    "fn_time": ("SELECT l_orderkey, l_linenumber, TIME(l_shipdate) AS t, DATETIME(l_shipdate, '+90 minutes') AS d, JULIANDAY(l_shipdate) AS j FROM lineitem",
        "SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%H:%M:%S') AS t, strftime(l_shipdate + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS d, epoch(l_shipdate) / 86400.0 + 2440587.5 AS j FROM lineitem"),
    "fn_timediff": ("SELECT o_orderkey, TIMEDIFF(o_orderdate, '1990-03-01') AS d FROM orders",
        "SELECT o_orderkey, printf('+%04d-%02d-%02d ', CAST(m // 12 AS INTEGER), CAST(m % 12 AS INTEGER), CAST(day(o_orderdate) - 1 AS INTEGER)) || strftime(o_orderdate, '%H:%M:%S.%g') AS d FROM (SELECT *, (year(o_orderdate) - 1990) * 12 + month(o_orderdate) - 3 AS m FROM orders)"),
    "fn_hints": ("SELECT p_partkey, LIKELY(p_size > 5) AS a, UNLIKELY(p_size) AS b, LIKELIHOOD(p_name, 0.9) AS c FROM part", "SELECT p_partkey, CAST(p_size > 5 AS BIGINT) AS a, p_size AS b, p_name AS c FROM part"),
    "fn_json_kinds": ("SELECT event_id, JSON_TYPE(props) AS a, JSON_TYPE(props, '$.k') AS b, JSON_EXTRACT(JSON_ARRAY(event_type, 'true', user_id), '$[#-2]') AS c, JSON_EXTRACT(JSON_OBJECT('x', event_type), '$.x') AS d, JSON_ARRAY_LENGTH(JSON_ARRAY(user_id, value, NULL)) AS e, JSON_QUOTE(event_type) AS q FROM events",
        "SELECT event_id, 'object' AS a, 'integer' AS b, 'true' AS c, event_type AS d, 3 AS e, '\"' || event_type || '\"' AS q FROM events"),
    "string_agg": ("SELECT n_regionkey, STRING_AGG(n_name, '/') AS s, JSON_GROUP_OBJECT(n_name, n_nationkey) AS o, GROUP_CONCAT(n_name, n_regionkey) AS g FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, '/' ORDER BY n_name) AS s, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS o, replace(string_agg(n_name, '|' ORDER BY n_name), '|', n_regionkey::VARCHAR) AS g FROM nation GROUP BY n_regionkey"),
    "join_left_agg": ("SELECT r.r_name, COUNT(s.s_suppkey) AS n, MAX(s.s_acctbal) AS top FROM region r LEFT JOIN nation n ON r.r_regionkey = n.n_regionkey LEFT JOIN supplier s ON n.n_nationkey = s.s_nationkey AND s.s_acctbal > 9000 GROUP BY r.r_name", None),
}
BATCH["fn_date"] = tuple(q.replace("AS over ", "AS later ") for q in BATCH["fn_date"])


def _engine(spark: SparkSession, sf_dir: str, tables: list[str]) -> Engine:
    engine = Engine(spark)
    for name in tables:
        engine.add_source(name, f"file://{sf_dir}/{name}.parquet")
    return engine


def _batch(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        statement = parse_one(text)
        return _engine(spark, sf_dir, [t.name for t in statement.tables()]).run(statement)

    return run


# --- windowed queries, with the recorded times of `events` as the clock


def _events(spark: SparkSession, sf_dir: str, kinds: str | None = None) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select("event_id", "user_id", "event_type", "value", micros(events, "ts").alias("arrival_us"), F.col("event_id").alias("seq"))
    return rows.where(F.col("event_type") == kinds) if kinds else rows


def _windowed(text: str, streams: dict[str, str | None], statics: tuple[str, ...] = (), as_: str = "snapshot") -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = {name: _events(spark, sf_dir, kind) for name, kind in streams.items()}
        tables = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in statics}
        return replay(spark, parse_one(text), frames, tables).withColumnRenamed(SNAPSHOT, as_)

    return run


_SPAN = "(SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events)"


def _tick_sql(every_us: int, width_us: int, shift_us: int = 0) -> str:
    return f"""ticks AS (
  SELECT DISTINCT tick, tick - (tick - {shift_us}) % {width_us} AS win FROM (
    SELECT unnest(range(lo + {every_us}, hi, {every_us})) AS tick FROM {_SPAN} UNION ALL SELECT hi FROM {_SPAN})
), ev AS (SELECT *, epoch_us(ts) AS us, epoch_us(ts) - (epoch_us(ts) - {shift_us}) % {width_us} AS win FROM events)"""


_HOUR = 3_600_000_000
_DAY = 24 * _HOUR
_WEEK_SHIFT = 345_600_000_000
WINDOWED: dict[str, tuple[Callable, str]] = {
    "every_ticks": (
        _windowed("SELECT event_type, COUNT(*) AS n, ROUND(SUM(value), 2) AS total FROM events GROUP BY event_type OVER 1h EVERY 20m", {"events": None}),
        f"WITH {_tick_sql(_HOUR // 3, _HOUR)} SELECT tick AS snapshot, event_type, count(*) AS n, round(sum(value), 2) AS total FROM ticks JOIN ev ON ev.win = ticks.win AND us <= tick GROUP BY tick, event_type",
    ),
    "tumbling_count": (
        _windowed("SELECT COUNT(*) AS n, MAX(value) AS top FROM events WHERE event_type = 'error' OVER 24h EVERY 12h", {"events": None}),
        f"WITH {_tick_sql(_DAY // 2, _DAY)} SELECT tick AS snapshot, count(event_id) AS n, max(value) AS top FROM (SELECT tick, win FROM ticks WHERE EXISTS (SELECT 1 FROM ev WHERE ev.win = ticks.win AND us <= tick)) t LEFT JOIN ev ON ev.win = t.win AND us <= tick AND event_type = 'error' GROUP BY tick",
    ),
    "tumbling_weeks": (
        _windowed("SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 3 OVER 168h EVERY 24h", {"events": None}),
        f"WITH {_tick_sql(_DAY, 7 * _DAY, _WEEK_SHIFT)}, c AS (SELECT tick, user_id, count(*) AS n FROM ticks JOIN ev ON ev.win = ticks.win AND us <= tick GROUP BY ALL) SELECT tick AS snapshot, user_id, n FROM c QUALIFY row_number() OVER (PARTITION BY tick ORDER BY n DESC, user_id) <= 3",
    ),
    "tumbling_join_static": (
        _windowed("SELECT c.c_mktsegment AS segment, COUNT(*) AS n FROM events e JOIN customer c ON e.user_id = c.c_custkey GROUP BY c.c_mktsegment OVER 6h EVERY 2h", {"events": None}, ("customer",)),
        f"WITH {_tick_sql(2 * _HOUR, 6 * _HOUR)} SELECT tick AS snapshot, c_mktsegment AS segment, count(*) AS n FROM ticks JOIN ev ON ev.win = ticks.win AND us <= tick JOIN customer ON user_id = c_custkey GROUP BY ALL",
    ),
    "per_record_snapshots": (
        _windowed("SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type OVER 1h", {"events": None}),
        f"WITH ev AS (SELECT *, epoch_us(ts) // {_HOUR} AS win FROM events) SELECT a.event_id AS snapshot, b.event_type, count(*) AS n FROM ev a JOIN ev b ON a.win = b.win AND b.event_id <= a.event_id GROUP BY ALL",
    ),
    "stream_left_static": (
        _windowed("SELECT e.event_id, c.c_name FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey AND c.c_acctbal > 0 WHERE e.event_type = 'purchase' OVER 30m EVERY 30m", {"events": None}, ("customer",)),
        f"WITH {_tick_sql(_HOUR // 2, _HOUR // 2)} SELECT tick AS snapshot, event_id, c_name FROM ticks JOIN ev ON ev.win = ticks.win AND us <= tick LEFT JOIN customer ON user_id = c_custkey AND c_acctbal > 0 WHERE event_type = 'purchase'",
    ),
    "stream_distinct": (
        _windowed("SELECT DISTINCT user_id FROM events OVER 2h EVERY 1h", {"events": None}),
        f"WITH {_tick_sql(_HOUR, 2 * _HOUR)} SELECT DISTINCT tick AS snapshot, user_id FROM ticks JOIN ev ON ev.win = ticks.win AND us <= tick",
    ),
    "stream_stream": (
        _windowed("SELECT a.event_id AS click, b.event_id AS bought FROM clicks a JOIN buys b ON a.user_id = b.user_id OVER 6h EVERY 3h", {"clicks": "click", "buys": "purchase"}),
        f"WITH span AS (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events WHERE event_type IN ('click', 'purchase')), ticks AS (SELECT DISTINCT tick, tick - tick % {6 * _HOUR} AS win FROM (SELECT unnest(range(lo + {3 * _HOUR}, hi, {3 * _HOUR})) AS tick FROM span UNION ALL SELECT hi FROM span)), ev AS (SELECT *, epoch_us(ts) AS us, epoch_us(ts) - epoch_us(ts) % {6 * _HOUR} AS win FROM events) SELECT tick AS snapshot, a.event_id AS click, b.event_id AS bought FROM ticks JOIN ev a ON a.win = ticks.win AND a.us <= tick AND a.event_type = 'click' JOIN ev b ON b.win = ticks.win AND b.us <= tick AND b.event_type = 'purchase' AND a.user_id = b.user_id",
    ),
}

# --- sources: tables are written out in another format to the shared folder and read back


def _from_file(text: str, table: str, form: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame, path = spark.read.parquet(f"{sf_dir}/{table}.parquet"), f"{scratch_path(spark, form)}.{form}"
        if form == "csv":
            frame.write.option("header", True).csv(path)
        else:
            frame.write.option("ignoreNullFields", False).json(path)
        return Engine(spark).add_source("t", path).sql(text)

    return run


def _json_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that stay in Arrow batches of the standard library's own engine."""
    text = "SELECT event_id, JSON_SET(props, '$.z', user_id) AS s, JSON_REMOVE(props, '$.k') AS r, JSON_PATCH(props, '{\"k\":null}') AS p, PRINTF('%.4f', value) AS f FROM events"
    return _engine(spark, sf_dir, ["events"]).sql(text)


def _lines_of(spark: SparkSession, sf_dir: str, table: str) -> str:
    """A table that has the same few rows at every scale, as the sink prints it."""
    out = io.StringIO()
    _engine(spark, sf_dir, [table]).print(f"SELECT * FROM {table}", out)
    return out.getvalue()


def _stdin_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed by the sink, read back as standard input, which an unbound table is."""
    return Engine(spark, stdin=io.StringIO(_lines_of(spark, sf_dir, "nation"))).sql("SELECT n_name, n_nationkey, n_regionkey FROM piped WHERE n_nationkey > 3")


def _changing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of two tables in one folder: their keys together are the columns."""
    path = f"{scratch_path(spark, 'mixed')}.jsonl"
    for table in ("nation", "region"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").write.mode("append").json(path)
    return Engine(spark).add_source("t", path).sql("SELECT n_name, r_name, COALESCE(n_regionkey, r_regionkey) AS k FROM t")


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two live streams of the few nations and regions, merged; what was printed last."""
    rows = {t: [json.loads(line) for line in _lines_of(spark, sf_dir, t).splitlines()] for t in ("nation", "region")}
    out = io.StringIO()
    text = "SELECT r.r_name AS region, COUNT(*) AS n FROM n JOIN r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name OVER 24h EVERY 1h"
    stream(Engine(spark), text, {"n": iter(rows["nation"]), "r": iter(rows["region"])}, out, clock=lambda: 1_700_000_000_000_000)
    return spark.createDataFrame([(r["region"], r["n"]) for r in map(json.loads, out.getvalue().splitlines())], "region string, n bigint")


def _sqlite_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of nations, which has the same few rows at every scale, as a SQLite table next to the others."""
    folder = scratch_path(spark, "sqlite").removeprefix("file://").removeprefix("file:")
    os.makedirs(folder)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").collect()]
    with sqlite3.connect(f"{folder}/nations.db") as db:
        db.execute("CREATE TABLE nations (n_nationkey INTEGER, n_name TEXT, n_regionkey INTEGER)")
        db.executemany("INSERT INTO nations VALUES (?, ?, ?)", rows)
    engine = _engine(spark, sf_dir, ["customer"]).add_source("n", f"sqlite://{folder}/nations.db?table=nations")
    return engine.sql("SELECT n.n_name, COUNT(*) AS customers, SUM(n.n_regionkey) / 2 AS halves FROM customer c JOIN n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name")


SOURCES: dict[str, tuple[Callable, str]] = {
    "fn_json_edits": (
        _json_edits,
        "SELECT event_id, json_merge_patch(props, json_object('z', user_id))::VARCHAR AS s, '{}' AS r, '{}' AS p, printf('%.4f', value) AS f FROM events",
    ),
    "stdin_source": (_stdin_source, "SELECT n_name, n_nationkey::DOUBLE AS n_nationkey, n_regionkey::DOUBLE AS n_regionkey FROM nation WHERE n_nationkey > 3"),
    "json_changing_keys": (_changing_keys, "SELECT n_name, NULL AS r_name, n_regionkey::DOUBLE AS k FROM nation UNION ALL SELECT NULL, r_name, r_regionkey FROM region"),
    "live_streams": (_live, "SELECT r_name AS region, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
    "csv_source": (
        _from_file("SELECT p_partkey, p_name, p_size / 4 AS quarter, p_retailprice FROM t WHERE p_size > 10", "part", "csv"),
        "SELECT p_partkey::DOUBLE AS p_partkey, p_name, p_size / 4.0::DOUBLE AS quarter, p_retailprice FROM part WHERE p_size > 10",
    ),
    "json_source": (
        _from_file("SELECT event_id, event_type, value * 2 AS twice, LENGTH(props) > 2 AS filled FROM t WHERE value IS NOT NULL", "events", "json"),
        "SELECT event_id::DOUBLE AS event_id, event_type, value * 2 AS twice, CAST(length(props) > 2 AS BIGINT) AS filled FROM events WHERE value IS NOT NULL",
    ),
    "json_containers": (
        _from_file("SELECT vec_id, label, LENGTH(embedding) > 2 AS filled, JSON_ARRAY_LENGTH(embedding) AS n FROM t", "embeddings", "json"),
        "SELECT vec_id::DOUBLE AS vec_id, label::DOUBLE AS label, 1 AS filled, len(embedding) AS n FROM embeddings",
    ),
    "sqlite_source": (
        _sqlite_source,
        "SELECT n_name, count(*) AS customers, sum(n_regionkey)::BIGINT // 2 AS halves FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    ),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: _batch(q) for n, (q, _) in BATCH.items()} | {n: f for n, (f, _) in (WINDOWED | SOURCES).items()}
SQL: dict[str, str] = {n: s or q for n, (q, s) in BATCH.items()} | {n: s for n, (_, s) in (WINDOWED | SOURCES).items()}
