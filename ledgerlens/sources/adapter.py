"""Derive a ``contracts`` table from the star-schema test tables.

The real contracts dataset is not available offline, so the test tables are
mapped onto the contract shape with plain relational work:
lineitem ⋈ orders ⋈ customer ⋈ supplier.  Every column has a rule, and the
rules deliberately produce nulls, repeated ids, inverted dates and bad URLs
so every branch of the method is exercised.

Scale notes: lineitem and orders are both large, so their join is a
shuffle (sort-merge) join on the order key; customer and supplier are
dimension tables whose size is measured by AQE at run time, which turns
those joins into broadcast joins only when they are small enough.  Customers
join the orders first, of which there are fewer than lines.  Only
the columns used below are read (column pruning reaches the scan).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# FIXED mapping of order priority to award modality.
MODALITY_BY_PRIORITY = {
    "1-URGENT": "Licitación pública",
    "2-HIGH": "Contratación directa (con ofertas)",
}
MODALITY_OTHER = "Contratación directa"


#: The tables and columns that contracts are made of.
READ_COLUMNS = {
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate"),
    "orders": ("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"),
    "customer": ("c_custkey", "c_name"),
    "supplier": ("s_suppkey", "s_name", "s_acctbal"),
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*READ_COLUMNS[name])


def _modality(priority: Column) -> Column:
    expr = F.lit(MODALITY_OTHER)
    for k, v in reversed(list(MODALITY_BY_PRIORITY.items())):
        expr = F.when(priority == k, F.lit(v)).otherwise(expr)
    return expr


def contracts_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, od, cu, su = (_table(spark, sf_dir, name) for name in READ_COLUMNS)

    # Orders take their customer's name, lines are cut to what a contract needs,
    # before lines meet orders: then the lines are shuffled once, and narrow.
    value = (F.col("l_extendedprice").cast("decimal(18,2)")
             * F.col("l_quantity").cast("decimal(4,0)")
             * F.lit(300)).cast("double")
    lines = li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate",
        F.when((F.col("l_discount") == 0.10) & (F.col("l_tax") == 0.08), F.lit(None))
         .otherwise(value).cast("double").alias("_value"),
        F.when(F.col("l_returnflag") == "R", F.col("l_quantity").cast("int"))
         .otherwise(F.lit(0)).cast("bigint").alias("_added"))
    signed = od.join(cu, F.col("o_custkey") == cu.c_custkey).select(
        "o_orderkey", "o_orderdate", "o_orderpriority", "c_name")
    j = (lines.join(signed, F.col("l_orderkey") == F.col("o_orderkey"))
         .join(su, F.col("l_suppkey") == su.s_suppkey))

    okey = F.col("l_orderkey").cast("string")
    line = F.col("l_linenumber").cast("string")
    pmod3 = F.pmod(F.col("l_partkey"), F.lit(3))
    return j.select(
        F.col("c_name").alias("entity"),
        F.concat(okey, F.lit("-"), line).alias("contract_id"),
        F.concat(F.lit("REF-"), okey, F.lit("-"), line, F.lit("-"),
                 F.col("l_partkey").cast("string")).alias("reference"),
        _modality(F.col("o_orderpriority")).alias("modality"),
        F.col("s_name").alias("supplier"),
        (F.col("s_acctbal") < 4000).alias("is_sme"),
        F.col("_value").alias("value"),
        F.col("_added").alias("added_days"),
        F.when(F.pmod(F.col("l_partkey"), F.lit(97)) == 0, F.lit(None))
         .otherwise(F.col("o_orderdate")).alias("signed_at"),
        F.col("o_orderdate").alias("start_at"),
        F.when(F.pmod(F.col("l_suppkey"), F.lit(53)) == 0, F.lit(None))
         .otherwise(F.col("l_shipdate")).alias("end_at"),
        F.when(pmod3 == 0, F.concat(F.lit("https://example.org/"), okey))
         .when(pmod3 == 1, F.lit("javascript:x"))
         .alias("process_url"),
    )


# The same mapping as DuckDB SQL, used by the correctness oracle.
CONTRACTS_SQL = """
SELECT
  c.c_name AS entity,
  CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS contract_id,
  'REF-' || CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR)
         || '-' || CAST(l.l_partkey AS VARCHAR) AS reference,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Licitación pública'
                         WHEN '2-HIGH' THEN 'Contratación directa (con ofertas)'
                         ELSE 'Contratación directa' END AS modality,
  s.s_name AS supplier,
  s.s_acctbal < 4000 AS is_sme,
  CASE WHEN l.l_discount = 0.10 AND l.l_tax = 0.08 THEN NULL
       ELSE CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST(l.l_quantity AS DECIMAL(4,0)) * 300 AS DOUBLE)
  END AS value,
  CAST(CASE WHEN l.l_returnflag = 'R' THEN CAST(l.l_quantity AS INTEGER) ELSE 0 END AS BIGINT) AS added_days,
  CASE WHEN l.l_partkey % 97 = 0 THEN NULL ELSE o.o_orderdate END AS signed_at,
  o.o_orderdate AS start_at,
  CASE WHEN l.l_suppkey % 53 = 0 THEN NULL ELSE l.l_shipdate END AS end_at,
  CASE l.l_partkey % 3 WHEN 0 THEN 'https://example.org/' || CAST(l.l_orderkey AS VARCHAR)
                       WHEN 1 THEN 'javascript:x' END AS process_url
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey
"""
