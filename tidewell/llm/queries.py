"""Queries p6 to p8 over the test tables, and DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.leaks import leak_counts, leak_recall, leaked_items
from tidewell.llm.splitting import LIMIT, OVERLAP, split_documents
from tidewell.llm.tokenizing import encode_corpus


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(_table(spark, sf_dir, "documents"))


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).where(F.col("distance") == 0).select("doc_id", "item_id")


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_counts(p7_leaks(spark, sf_dir))


def p7_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each leaked item the number of documents that hold a passage exactly."""
    return p7_items(spark, sf_dir).where(F.col("n_exact") > 0).select("item_id", "n_exact")


def p7_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the documents whose id is divisible by 50, as the query set, the matches with all items and how many of them are found."""
    documents = _table(spark, sf_dir, "documents")
    return leak_recall(documents.where(F.col("doc_id") % 50 == 0), _table(spark, sf_dir, "eval_items"))


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_documents(_table(spark, sf_dir, "documents"))


def p8_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's pieces put together again, and whether all are numbered, within the limit, and overlap as they may."""
    pieces = split_documents(_table(spark, sf_dir, "documents"), keep_small=True)
    body = F.substring("piece", F.col("body_char") - F.col("start_char") + 1, F.col("end_char") - F.col("body_char"))
    joined = pieces.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("piece_no", body.alias("body")))).alias("parts"),
        F.max("n_tokens").alias("most"), F.max("overlap_tokens").alias("overlap"), F.max("n_pieces").alias("n"), F.countDistinct("piece_no").alias("numbers"),
    )
    return joined.select(
        "doc_id", F.array_join(F.transform("parts", lambda p: p["body"]), "").alias("text"),
        ((F.col("most") <= LIMIT) & (F.col("overlap") <= OVERLAP) & (F.col("n") == F.col("numbers"))).alias("fits"),
    )


QUERIES = {f.__name__: f for f in (p6_ids, p7_found, p7_leaks, p7_items, p7_exact, p7_recall, p8_pieces, p8_joined)}

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_FOUND = f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM eval_items), d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT item_id, w, least(12, len(w)) AS n FROM i WHERE len(w) > 0),
ig AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM s)),
sizes AS (SELECT DISTINCT n FROM s),
dg AS (SELECT DISTINCT doc_id, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (n, g))"""

SQL = {
    "p7_found": _FOUND + "SELECT doc_id, item_id FROM found",
    "p7_exact": _FOUND + "SELECT item_id, count(*) AS n_exact FROM found GROUP BY item_id",
    "p8_joined": "SELECT doc_id, text, true AS fits FROM documents WHERE text IS NOT NULL",
}
