"""Queries on splits, folds and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenloom.operators import splitting, summaries
from screenloom.plans import inputs as I
from screenloom.plans.cleaning_queries import resolve_labels
from screenloom.plans.registry import query
from screenloom.session import scratch_path, stored
from screenloom.sources import records
from screenloom.sources.tables import read_table

SQL_SPLIT_OF = """
ranked AS (
  SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || id)) AS rn FROM base
),
c0 AS (SELECT label, count(*) AS n_c, sum(count(*)) OVER () AS n FROM base GROUP BY label),
c1 AS (SELECT *, ceil(0.15::DOUBLE * n) AS n_test, ceil(0.15::DOUBLE * n) * n_c / n AS exact FROM c0),
c2 AS (
  SELECT *, floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, label)
      <= n_test - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS q_test FROM c1
),
c3 AS (
  SELECT label, q_test, n_c - q_test AS rest, sum(n_c - q_test) OVER () AS n_rest,
         ceil((0.15::DOUBLE / (0.7::DOUBLE + 0.15::DOUBLE)) * sum(n_c - q_test) OVER ()) AS n_val FROM c2
),
c4 AS (
  SELECT *, n_val * rest / n_rest AS exact FROM c3
),
quota AS (
  SELECT label, q_test, floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, label)
      <= n_val - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS q_val FROM c4
),
split AS (
  SELECT id, label, CASE WHEN rn <= q_test THEN 'test' WHEN rn <= q_test + q_val THEN 'val' ELSE 'train' END AS split
  FROM ranked JOIN quota USING (label)
)
"""

_SQL_DOC_SPLIT = (
    "WITH " + I.SQL_LABELLED + ", base AS (SELECT key_digest AS id, label FROM resolved)," + SQL_SPLIT_OF
)
_SQL_ORDER_SPLIT = (
    """WITH base AS (SELECT CAST(o_orderkey AS VARCHAR) AS id,
    CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS INTEGER) AS label FROM orders),"""
    + SQL_SPLIT_OF
)


def _doc_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = resolve_labels(spark, sf).select(F.col("key_digest").alias("id"), "label")
    # The split reads its input three times; store the resolved rows once instead
    # of resolving them three times.
    return splitting.stratified_split(stored(rows, "resolved"), id_col="id")


def _order_rows(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
    )


@query("stratified_split", _SQL_DOC_SPLIT + "SELECT id, label, split FROM split")
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return _doc_split(spark, sf)


@query("stratified_split_orders", _SQL_ORDER_SPLIT + "SELECT id, label, split FROM split")
def stratified_split_orders(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.stratified_split(_order_rows(spark, sf), id_col="id")


@query(
    "split_stats",
    _SQL_DOC_SPLIT
    + """SELECT split, count(*) AS size, count(*) FILTER (label = 1) AS toxic, count(*) FILTER (label = 0) AS nontoxic,
            count(*) FILTER (label = 1) / count(*) AS toxic_ratio FROM split GROUP BY split""",
)
def split_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Splits are written one folder each, then summed up from the stored table."""
    path = scratch_path(spark, "splits")
    records.write_splits(_doc_split(spark, sf), path)
    return summaries.split_stats(spark.read.parquet(path))


@query("split_disjoint", _SQL_DOC_SPLIT + "SELECT md5(id) AS key_digest FROM split GROUP BY id HAVING count(DISTINCT split) > 1")
def split_disjoint(spark: SparkSession, sf: str) -> DataFrame:
    """Empty when no key sits in two splits."""
    return splitting.split_overlap(_doc_split(spark, sf), key="id")


@query(
    "stratified_folds",
    """WITH base AS (SELECT CAST(o_orderkey AS VARCHAR) AS id,
         CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS INTEGER) AS label FROM orders),
       ranked AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || id)) - 1 AS r,
                         count(*) OVER (PARTITION BY label) AS n FROM base)
       SELECT id, label,
         CAST(CASE WHEN r < (n % 5) * (n // 5 + 1) THEN r // (n // 5 + 1)
              ELSE (n % 5) + (r - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS fold
       FROM ranked""",
)
def stratified_folds(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.stratified_folds(_order_rows(spark, sf), id_col="id")


@query(
    "sample_rows",
    "SELECT doc_id, lang, source FROM documents ORDER BY md5('42:' || doc_id) LIMIT 100",
)
def sample_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "documents").select("doc_id", "lang", "source")
    return splitting.sample_rows(rows, id_col="doc_id")
