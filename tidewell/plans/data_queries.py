"""Queries p1 to p5 over the test tables, and DuckDB SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.isotime import iso_micros, iso_micros_sql
from tidewell.operators import features, hotkeys, orphans, rejects, sessions
from tidewell.runtime import exact_double_key, inexact_keys, micros

DOMINATING_SHARE = 0.02


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- 1: rows that fail to parse


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.parse_records(_table(spark, sf_dir, "raw_lines"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.rejected(_parsed(spark, sf_dir)).select("line_id", "reason")


def p1_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failing records with their reasons; the operator has the reader's own words, too."""
    return rejects.rejected(_parsed(spark, sf_dir)).drop("detail")


def p1_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.loaded_users(_parsed(spark, sf_dir))


def p1_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.loaded_products(_parsed(spark, sf_dir))


# --- 2: references that don't hold


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    users, products = _table(spark, sf_dir, "users"), _table(spark, sf_dir, "products")
    orders, events = _table(spark, sf_dir, "shop_orders"), _table(spark, sf_dir, "user_events")
    parents = [
        orphans.Parent("users", users, F.col("id"), micros(users, "updated_at"), micros(users, "created_at"), micros(users, "deleted_at")),
        orphans.Parent("products", products, F.col("id"), F.lit(0).cast("bigint"), micros(products, "created_at"), micros(products, "deleted_at")),
    ]
    order_id, ordered = exact_double_key(F.col("order_id")), micros(orders, "ordered_at")
    references = [
        orphans.Reference("users", "shop_orders", "user_id", orders, F.col("user_id"), order_id, ordered),
        orphans.Reference("products", "shop_orders", "product_id", orders, F.col("product_id"), order_id, ordered),
        orphans.Reference("users", "user_events", "user_id", events, F.col("user_id"), F.col("event_id"), iso_micros(F.col("ts")), timed=True),
    ]
    return orphans.orphan_references(parents, references)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("ref_table", "ref_field", "record_id", "period")


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_counts(_orphans(spark, sf_dir))


# --- 3: a few keys that hold most records


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, events = _table(spark, sf_dir, "shop_orders"), _table(spark, sf_dir, "user_events")
    return orders.select(
        F.lit("shop_orders").alias("ref_table"), exact_double_key(F.col("user_id")).alias("user_id"), F.col("quantity").alias("amount")
    ).unionByName(events.select(F.lit("user_events").alias("ref_table"), exact_double_key(F.col("user_id")).alias("user_id"), "amount"))


def p3_user_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, amounts and their sum, least and greatest for each table and user, as stored; amount is the quantity of orders."""
    return hotkeys.per_key_totals(
        _keyed(spark, sf_dir).where(F.col("user_id").isNotNull()),
        ["ref_table", "user_id"],
        {
            "n_rows": F.count(F.lit(1)), "n_amounts": F.count("amount"), "total": F.round(F.sum("amount"), 2), "least": F.min("amount"), "greatest": F.max("amount"),
        },
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hotkeys.dominating_keys(_keyed(spark, sf_dir), "ref_table", "user_id", DOMINATING_SHARE).select("ref_table", "user_id")


def p3_inexact_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table whose key is given but no exact whole number; per-user results have no row for them."""
    tables = {"shop_orders": ["user_id", "product_id", "order_id"], "user_events": ["user_id"]}
    found = [inexact_keys(_table(spark, sf_dir, t).withColumn("ref_table", F.lit(t)), "ref_table", keys) for t, keys in tables.items()]
    return found[0].unionByName(found[1])


# --- 4: sessions


def p4_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "user_events")
    ms = F.floor(iso_micros(F.col("ts")) / F.lit(1000)).cast("bigint")
    return sessions.sessions(events, exact_double_key(F.col("user_id")), F.col("event_id"), ms).withColumnRenamed("entity", "user_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_sessions(spark, sf_dir).select("user_id", "session_start_ms", "session_end_ms")


# --- 5: features


def _event_cells(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", exact_double_key(F.col("user_id")).alias("entity"), features.normal_type(F.col("action")).alias("type"), iso_micros(F.col("ts")).alias("us"), "amount"
    )


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.feature_rows(spark, f"{sf_dir}/user_events.parquet", _event_cells)


def p5_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each user; ``cells`` has by action the count, the seconds from the last such event to the table's last event, and the total amount."""
    rows = _features(spark, sf_dir)
    return features.with_recency(rows, features.latest_us(rows)).withColumnRenamed("entity", "user_id")


def p5_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of the feature table in long form."""
    rows = p5_features(spark, sf_dir).select("user_id", F.explode("cells").alias("action", "cell"))
    return rows.select("user_id", "action", "cell.n", F.round("cell.since_s", 3).alias("since_s"), F.round("cell.total", 2).alias("total"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.map_filter("cells", lambda _, cell: cell["n"] > 0)
    return _features(spark, sf_dir).select(F.col("entity").alias("user_id"), F.explode(F.map_keys(cells)).alias("action"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_rejects, p1_users, p1_products, p2_found, p2_counts, p3_found, p3_user_totals, p3_inexact_keys, p4_found, p4_sessions, p5_found, p5_features, p5_cells)
}

_Q = '"([^"]|"")*"'
_F = f'({_Q}|[^",]*)'
_US = iso_micros_sql("ts")
_TEXT = '''trim(CASE WHEN raw LIKE '"%' THEN replace(raw[2:-2], '""', '"') ELSE raw END, ' ' || chr(9) || chr(10) || chr(13))'''
_LINES = f"""
WITH l AS (
  SELECT line_id, feed, file_name, line_no, coalesce(line, '') AS line FROM raw_lines
), shaped AS (
  SELECT *, regexp_full_match(line, '(?s){_F}(,{_F})*') AS fits, regexp_replace(line, '(?s){_Q}', '', 'g') AS bare,
    regexp_extract(line, '(?s)^{_F},{_F},{_F},{_F}$', [
      'f1', 'q1', 'f2', 'q2', 'f3', 'q3', 'f4', 'q4']) AS f
  FROM l
), counted AS (
  SELECT *, length(bare) - length(replace(bare, ',', '')) + 1 AS n_fields FROM shaped
), texted AS (
  SELECT *, CASE feed WHEN 'users' THEN f.f4 WHEN 'products' THEN f.f3 ELSE '' END AS raw FROM counted
), cut AS (
  SELECT *, {_TEXT} AS txt FROM texted
), valued AS (
  SELECT *, regexp_full_match(txt, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') AS plain, TRY_CAST(ltrim(txt, '+') AS DOUBLE) AS num FROM cut
), judged AS (
  SELECT *, CASE WHEN NOT fits THEN 'quoting' WHEN n_fields <> 4 THEN 'column_count'
    WHEN txt <> '' AND (NOT plain OR num IS NULL OR isinf(num) OR num < 0 OR (feed = 'users' AND num > 150)) THEN 'value' END AS reason
  FROM valued
)"""


def _plain(name: str) -> str:
    return f"CASE WHEN f.{name} LIKE '\"%' THEN replace(f.{name}[2:-2], '\"\"', '\"') ELSE f.{name} END"


_LIVES = """
WITH u AS (
  SELECT id, any_value(created_at) AS created_at, max_by(struct_pack(d := deleted_at), updated_at).d AS deleted_at FROM users WHERE id IS NOT NULL GROUP BY id
), p AS (
  SELECT DISTINCT id, created_at, deleted_at FROM products WHERE id IS NOT NULL
), e AS (
  SELECT event_id, user_id, """ + _US + """ AS us FROM user_events
), refs AS (
  SELECT DISTINCT 'shop_orders' AS ref_table, 'user_id' AS ref_field, CAST(order_id AS BIGINT) AS record_id, epoch_us(ordered_at) AS us, 'u' AS parent, user_id AS k FROM shop_orders
  UNION ALL
  SELECT DISTINCT 'shop_orders', 'product_id', CAST(order_id AS BIGINT), epoch_us(ordered_at), 'p', product_id FROM shop_orders
  UNION ALL
  SELECT DISTINCT 'user_events', 'user_id', event_id, us, 'u', user_id FROM e WHERE us IS NOT NULL
), lives AS (
  SELECT 'u' AS parent, * FROM u UNION ALL SELECT 'p', * FROM p
), found AS (
  SELECT ref_table, ref_field, record_id, strftime(date_trunc('week', make_timestamp(us)), '%Y-%m-%d') AS period,
    CASE WHEN l.id IS NULL THEN 'missing' WHEN us < epoch_us(created_at) THEN 'not_yet_created' WHEN us >= epoch_us(deleted_at) THEN 'already_deleted' END AS cause
  FROM refs LEFT JOIN lives l ON l.parent = refs.parent AND l.id = k WHERE k IS NOT NULL
)"""
_EVENTS = f"""
WITH e AS (
  SELECT DISTINCT event_id, CAST(user_id AS BIGINT) AS user_id, {_US} AS us, lower(trim(action, ' ' || chr(9))) AS action FROM user_events
  WHERE user_id IS NOT NULL AND event_id IS NOT NULL
), ok AS (SELECT * FROM e WHERE us IS NOT NULL)"""
_SESSIONS = _EVENTS + """, t AS (SELECT user_id, us // 1000 AS ms FROM ok
), marked AS (
  SELECT *, CASE WHEN ms - lag(ms) OVER w <= 1800000 THEN 0 ELSE 1 END AS fresh FROM t WINDOW w AS (PARTITION BY user_id ORDER BY ms)
), numbered AS (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS s FROM marked
)"""
_KEYED = """
WITH k AS (
  SELECT 'shop_orders' AS ref_table, CAST(user_id AS BIGINT) AS user_id, quantity AS amount FROM shop_orders
  UNION ALL SELECT 'user_events', CAST(user_id AS BIGINT), amount FROM user_events
)"""

SQL = {
    "p1_found": _LINES + "SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p1_rejects": _LINES.replace("SELECT line_id, feed, file_name, line_no, coalesce(line, '') AS line", "SELECT line_id, feed, file_name, line_no, line AS own, coalesce(line, '') AS line")
    + "SELECT line_id, feed, file_name, line_no, reason, own AS line FROM judged WHERE reason IS NOT NULL",
    "p3_inexact_keys": """
WITH k AS (
  SELECT 'shop_orders' AS ref_table, 'user_id' AS field, user_id AS v FROM shop_orders UNION ALL SELECT 'shop_orders', 'product_id', product_id FROM shop_orders
  UNION ALL SELECT 'shop_orders', 'order_id', order_id FROM shop_orders UNION ALL SELECT 'user_events', 'user_id', user_id FROM user_events
)
SELECT ref_table, field, count(*) AS n_rows, count(*) FILTER (v <> floor(v) OR abs(v) > 9007199254740992) AS n_inexact FROM k GROUP BY ref_table, field""",
    "p1_users": _LINES
    + f"SELECT line_id, file_name, line_no, TRY_CAST(trim({_plain('f1')}) AS DOUBLE) AS id, {_plain('f2')} AS name, {_plain('f3')} AS email, CASE WHEN txt <> '' THEN num END AS age FROM judged WHERE reason IS NULL AND feed = 'users'",
    "p1_products": _LINES
    + f"SELECT line_id, file_name, line_no, TRY_CAST(trim({_plain('f1')}) AS DOUBLE) AS id, {_plain('f2')} AS name, CASE WHEN txt <> '' THEN num END AS price, {_plain('f4')} AS category FROM judged WHERE reason IS NULL AND feed = 'products'",
    "p2_found": _LIVES + "SELECT ref_table, ref_field, record_id, period FROM found WHERE cause IS NOT NULL",
    "p2_counts": _LIVES + "SELECT ref_table, ref_field, period, cause, count(*) AS n_orphans FROM found WHERE cause IS NOT NULL GROUP BY ALL",
    "p3_found": _KEYED
    + "SELECT ref_table, user_id FROM (SELECT ref_table, user_id, count(*) AS n, sum(count(*)) OVER (PARTITION BY ref_table) AS total FROM k GROUP BY ref_table, user_id) WHERE user_id IS NOT NULL AND n > 0.02 * total",
    "p3_user_totals": _KEYED
    + "SELECT ref_table, user_id, count(*) AS n_rows, count(amount) AS n_amounts, round(sum(amount), 2) AS total, min(amount) AS least, max(amount) AS greatest FROM k WHERE user_id IS NOT NULL GROUP BY ref_table, user_id",
    "p4_found": _SESSIONS + "SELECT user_id, min(ms) AS session_start_ms, max(ms) AS session_end_ms FROM numbered GROUP BY user_id, s",
    "p4_sessions": _SESSIONS
    + "SELECT user_id, min(ms) AS session_start_ms, max(ms) AS session_end_ms, max(ms) - min(ms) AS duration_ms, count(*) AS n_events FROM numbered GROUP BY user_id, s",
    "p5_cells": _EVENTS.replace("lower(trim(action", "any_value(amount) AS amount, lower(trim(action").replace("SELECT DISTINCT", "SELECT").replace(
        "AND event_id IS NOT NULL", "AND event_id IS NOT NULL GROUP BY event_id, user_id, ts, action"
    )
    + """, c AS (SELECT user_id, action, count(*) AS n, max(us) AS last_us, sum(coalesce(amount, 0)) AS total FROM ok WHERE action <> '' GROUP BY user_id, action)
SELECT user_id, action, n, round(((SELECT max(last_us) FROM c) - last_us) / 1e6, 3) AS since_s, round(total, 2) AS total FROM c""",
    "p5_found": _EVENTS + "SELECT DISTINCT user_id, action FROM ok WHERE action <> ''",
}
