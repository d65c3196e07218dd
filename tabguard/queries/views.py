"""Dirty views of the clean test tables, as expressions that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ORDERS = {
    "id": "o_orderkey",
    "cust": "o_custkey",
    "amount": "CASE o_orderkey % 11 WHEN 0 THEN NULL WHEN 1 THEN ' N/A ' WHEN 2 THEN '1,5' WHEN 3 THEN '1,234.5' WHEN 4 THEN 'abc' WHEN 5 THEN '' WHEN 6 THEN '-3' WHEN 7 THEN '0' WHEN 8 THEN 'NaN' WHEN 9 THEN '2.7' ELSE CAST(o_custkey AS STRING) END",
    "amount2": "CASE o_custkey % 7 WHEN 0 THEN '0' WHEN 1 THEN '2' WHEN 2 THEN 'NA' WHEN 3 THEN '10' WHEN 4 THEN '-1,5' WHEN 5 THEN 'x' ELSE CAST(o_orderkey % 50 AS STRING) END",
    "amount3": "CASE o_orderkey % 5 WHEN 0 THEN '3' WHEN 1 THEN '1.5' WHEN 2 THEN NULL WHEN 3 THEN '12' ELSE CAST(o_custkey % 20 AS STRING) END",
    "day": "CASE o_orderkey % 9 WHEN 0 THEN '2024-01-31' WHEN 1 THEN '31.01.2024' WHEN 2 THEN '1/2/2023' WHEN 3 THEN '20231231' WHEN 4 THEN '2024-02-30' WHEN 5 THEN '2024-06-30 12:00:00' WHEN 6 THEN 'Not available' WHEN 7 THEN '2025-3-1' ELSE NULL END",
    "day2": "CASE o_custkey % 4 WHEN 0 THEN '2023-12-31' WHEN 1 THEN '1.1.2024' WHEN 2 THEN 'soon' ELSE '20240601' END",
    "isin": "CASE o_orderkey % 6 WHEN 0 THEN 'DE000A1EWWW0' WHEN 1 THEN 'US0378331005' WHEN 2 THEN 'de0005140008' WHEN 3 THEN 'XS12345' WHEN 4 THEN 'FR00000ABCDX' ELSE '' END",
    "idtype": "CASE o_custkey % 4 WHEN 0 THEN 'ISIN' WHEN 1 THEN 'Isin code' WHEN 2 THEN 'CUSIP' ELSE NULL END",
    "lei": "CASE o_orderkey % 4 WHEN 0 THEN '5299000000000000' || lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0') WHEN 1 THEN 'short' WHEN 2 THEN lower('5299000000000000ABCD') ELSE 'N/A' END",
    "country": "CASE o_orderkey % 7 WHEN 0 THEN 'DE' WHEN 1 THEN 'fr' WHEN 2 THEN 'US-NY' WHEN 3 THEN 'ZZ' WHEN 4 THEN 'Germany' WHEN 5 THEN NULL ELSE 'AT' END",
    "currency": "CASE o_orderkey % 5 WHEN 0 THEN 'EUR' WHEN 1 THEN 'usd' WHEN 2 THEN 'XYZ' WHEN 3 THEN '' ELSE 'EURO' END",
    "bic": "CASE o_orderkey % 5 WHEN 0 THEN 'DEUTDEFF' WHEN 1 THEN 'DEUTDEFF500' WHEN 2 THEN 'DEUTDE' WHEN 3 THEN 'deutdeff' ELSE NULL END",
    "yesno": "CASE o_orderkey % 6 WHEN 0 THEN 'true' WHEN 1 THEN '1' WHEN 2 THEN 'yes' WHEN 3 THEN 'False' WHEN 4 THEN ' 0' ELSE NULL END",
    "category": "CASE o_orderkey % 8 WHEN 0 THEN lower(o_orderpriority) WHEN 1 THEN ' ' || o_orderpriority WHEN 2 THEN 'Not available' ELSE o_orderpriority END",
    "flag": "CASE o_custkey % 3 WHEN 0 THEN '0' WHEN 1 THEN '1' ELSE 'T1' END",
    "result": "CASE o_orderkey % 4 WHEN 0 THEN CAST((o_orderkey % 100) + (o_custkey % 10) AS STRING) WHEN 1 THEN '1,000' WHEN 2 THEN NULL ELSE CAST(o_orderkey % 30 AS STRING) END",
    "part_a": "CAST(o_orderkey % 100 AS STRING)",
    "part_b": "CASE o_custkey % 6 WHEN 0 THEN 'N/A' ELSE CAST(o_custkey % 10 AS STRING) END",
    "big": "CASE o_orderkey % 7 WHEN 0 THEN '1e999' WHEN 1 THEN '-1e400' WHEN 2 THEN '1.7' WHEN 3 THEN '1,000e2' WHEN 4 THEN 'x1' WHEN 5 THEN 'n/a' ELSE '3' END",
    "product": "CASE o_custkey % 3 WHEN 0 THEN 'Non-structured/Vanilla' WHEN 1 THEN 'Non-Structured/Vanilla' ELSE NULL END",
}
ORDERS_SQL = "(SELECT " + ", ".join(f"{e} AS {n}" for n, e in ORDERS.items()) + " FROM orders)"


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*[f"{e} AS {n}" for n, e in ORDERS.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The predicates once more, as SQL text of the checking engine.
_STRIP = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
_NUMBER = "[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"


def strip(f: str) -> str:
    return f"trim({f}, {_STRIP})"


def miss(f: str) -> str:
    return f"({f} IS NULL OR lower({strip(f)}) IN ('', 'none', 'nan', 'nat', 'n/a', 'na', 'not available', 'not applicable'))"


def num(f: str) -> str:
    return f"(CASE WHEN regexp_full_match({strip(f)}, '{_NUMBER}') THEN TRY_CAST({strip(f)} AS DOUBLE) END)"


def grouped(f: str) -> str:
    return num(f"replace({f}, ',', '')")


def decimal(f: str) -> str:
    return f"(CASE WHEN NOT {miss(f)} THEN {num(f"replace({f}, ',', '.')")} END)"


def date(f: str) -> str:
    parts = ", ".join(f"try_strptime({strip(f)}, '{p}')" for p in ("%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y", "%Y%m%d"))
    return f"(CASE WHEN NOT {miss(f)} THEN CAST(coalesce({parts}) AS DATE) END)"


def listed(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"
