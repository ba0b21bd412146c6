"""The query files of the SQL front door as queries, over coded and over named views, with the same text for DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import sql
from ..catalog import SQL_VIEWS

_NAMED = SQL_VIEWS + r""",
n_part AS (
  SELECT p_partkey, 'MFGR#' || (p_mfgr + 1) AS p_mfgr, 'MFGR#' || (p_mfgr + 1) || (p_category % 5 + 1) AS p_category,
    'MFGR#' || (p_mfgr + 1) || (p_category % 5 + 1) || (p_brand1 % 40 + 1) AS p_brand1 FROM s_part),
n_supplier AS (
  SELECT s_suppkey, n_name AS s_nation, r_name AS s_region, rpad(n_name[1:9], 9, ' ') || (s_suppkey % 10) AS s_city
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
n_customer AS (
  SELECT c_custkey, n_name AS c_nation, r_name AS c_region, rpad(n_name[1:9], 9, ' ') || (c_custkey % 10) AS c_city
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
n_ddate AS (
  SELECT *, strftime(strptime(CAST(d_datekey AS VARCHAR), '%Y%m%d'), '%b%Y') AS d_yearmonth,
    (dayofyear(strptime(CAST(d_datekey AS VARCHAR), '%Y%m%d')) - 1) // 7 + 1 AS d_weeknuminyear FROM ddate)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(prefix: str, names: str, views: str, renamed: dict[str, str]) -> None:
    files = sql.suite(str(sql.QUERIES / f"{names}.txt")) + ([str(sql.QUERIES / "coded" / "p1.sql")] if names == "coded" else [])
    for file in files:
        name = f"{prefix}_{re.split(r'[/.]', file)[-2]}"
        QUERIES[name] = lambda spark, data, file=file: sql.run_file(spark, data, file, names)
        text = re.sub(r"(?<=FROM )[^\n]+", lambda m: ", ".join(f"{renamed.get(t, t)} AS {t}" for t in m[0].split(", ")), sql.load(file))
        SQL[name] = views + re.sub(r"sum\(([^()]+)\)", r"CAST(sum(\1) AS BIGINT)", text)


_add("sql", "coded", SQL_VIEWS, {"part": "s_part", "supplier": "s_supplier", "customer": "s_customer"})
_add("orig", "named", _NAMED, {"part": "n_part", "supplier": "n_supplier", "customer": "n_customer", "ddate": "n_ddate"})
QUERIES["sql_default"] = lambda spark, data: sql.run_file(spark, data)
SQL["sql_default"] = SQL_VIEWS + sql.DEFAULT.replace("part, supplier", "s_part, s_supplier").replace("sum(lo_revenue)", "CAST(sum(lo_revenue) AS BIGINT)")
