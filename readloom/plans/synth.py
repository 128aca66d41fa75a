"""Alignments derived from the star-schema tables, in whole-number arithmetic that Spark and other engines share.

``from_lineitem`` has no ordinal (the table has no key); ``from_orders`` has
the order key as ordinal. ``SQL`` gives both as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FIELDS = """
  CAST(CASE WHEN ok % 53 = 0 THEN -1 ELSE pk % 25 END AS INT) AS ref_id,
  CAST(CASE WHEN ok % 101 = 0 THEN -1 ELSE (ok * 7 + ln * 131 + pk * 17) % 5000 END AS INT) AS pos,
  CAST((ok + ln) % 61 AS SMALLINT) AS mapq,
  CAST((CASE WHEN ok % 3 <> 0 THEN 1 ELSE 0 END) + (CASE WHEN ok % 3 = 1 THEN 2 ELSE 0 END) + (CASE WHEN ok % 53 = 0 THEN 4 ELSE 0 END)
    + (CASE WHEN pk % 11 = 0 THEN 8 ELSE 0 END) + (CASE WHEN sk % 2 = 0 THEN 16 ELSE 0 END) + (CASE WHEN ln % 2 = 1 THEN 64 ELSE 128 END)
    + (CASE WHEN pk % 13 = 0 THEN 256 ELSE 0 END) + (CASE WHEN pk % 17 = 0 THEN 512 ELSE 0 END) + (CASE WHEN sk % 19 = 0 THEN 1024 ELSE 0 END)
    + (CASE WHEN pk % 23 = 0 THEN 2048 ELSE 0 END) AS INT) AS flag,
  CAST(sk % 25 AS INT) AS next_ref_id,
  CAST((ok * 3 + sk) % 5000 AS INT) AS next_pos,
  CAST(ln * 50 - sk % 100 AS INT) AS tlen,
  concat('r', CAST(ok % 997 AS STRING)) AS read_name,
  CASE WHEN ok % 7 = 0 THEN '10S' WHEN ln % 3 > 0 THEN concat('5S', CAST(20 + 10 * ln AS STRING), 'M', CAST(ln % 3 AS STRING), 'D4=')
    ELSE concat('5S', CAST(20 + 10 * ln AS STRING), 'M2I3X') END AS cigar_text,
  CAST(CASE WHEN ok % 7 = 0 THEN 0 WHEN ln % 3 > 0 THEN 24 + 10 * ln + ln % 3 ELSE 23 + 10 * ln END AS BIGINT) AS span,
  CAST(CASE WHEN ok % 7 = 0 THEN 10 WHEN ln % 3 > 0 THEN 29 + 10 * ln ELSE 30 + 10 * ln END AS BIGINT) AS read_length,
  CASE WHEN sk % 3 = 0 THEN NULL ELSE ln END AS hi"""

_LINEITEM = "SELECT l_orderkey AS ok, l_partkey AS pk, l_suppkey AS sk, l_linenumber AS ln FROM lineitem"
_ORDERS = "SELECT o_orderkey AS ordinal, o_orderkey AS ok, o_custkey AS pk, o_custkey % 100 AS sk, CAST(1 + o_orderkey % 7 AS INT) AS ln FROM orders"
_REFS = "SELECT n_nationkey AS ref_id, n_name AS name, CAST(6000 + 10 * n_nationkey AS BIGINT) AS length FROM nation"

#: For an engine whose text type is VARCHAR and that reads STRING as it.
SQL = f"""
a AS (SELECT {_FIELDS} FROM ({_LINEITEM})),
o AS (SELECT ordinal, {_FIELDS} FROM ({_ORDERS})),
refs AS ({_REFS})"""


def _table(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def _fields(rows: DataFrame, *first: str) -> DataFrame:
    return rows.selectExpr(*first, *[f.strip() for f in _split(_FIELDS)])


def _split(fields: str) -> list[str]:
    """The fields of a select list; commas within parentheses don't part."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(fields):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(fields[last:i])
            last = i + 1
    return [*out, fields[last:]]


def from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]).toDF("ok", "pk", "sk", "ln")
    return _fields(rows)


def from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"]).selectExpr("o_orderkey AS ordinal", "o_orderkey AS ok", "o_custkey AS pk", "o_custkey % 100 AS sk", "CAST(1 + o_orderkey % 7 AS INT) AS ln")
    tags = "CASE WHEN hi IS NULL THEN array(struct('RG' AS tag, 'Z' AS type, read_name AS value)) ELSE array(struct('RG' AS tag, 'Z' AS type, read_name AS value), struct('HI' AS tag, 'i' AS type, CAST(hi AS STRING) AS value)) END AS tags"
    return _fields(rows, "ordinal").selectExpr("*", tags)


def ref_seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "nation", ["n_nationkey", "n_name"]).select(F.col("n_nationkey").alias("ref_id"), F.col("n_name").alias("name"), (6000 + 10 * F.col("n_nationkey")).cast("long").alias("length"))
