"""The thirteen star-schema queries, the count variant and the default query, as builders and as SQL.

Years are those of the data (1995 to 2001); cities of q33 and q34 are ones that occur.
Conditions on what is made of raw columns are said on these as well, for the scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import SQL_VIEWS, Star, days, in_range
from ..functions.arithmetic import mul
from ..operators.star_join import Dim

c = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, build: Callable[[Star], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(Star(spark, sf_dir))
    SQL[name] = SQL_VIEWS + sql


def _q1(where: str, dates: str, lines: str) -> Callable[[Star], DataFrame]:
    """where holds on lineorder; dates and lines say the same, or less, on the raw columns."""
    return lambda s: s.joined([], lines, dates, where).agg(F.sum(mul("lo_extendedprice", "lo_discount")).alias("revenue"))


_Q1 = "SELECT CAST(sum(lo_extendedprice * lo_discount) AS BIGINT) AS revenue FROM lineorder WHERE "
_add("ssb_q11", _q1("lo_discount BETWEEN 1 AND 3 AND lo_quantity < 25", days("1996-01-01", "1997-01-02"), f"{in_range('l_discount', 0.005, 0.035)} AND {in_range('l_quantity', None, 25)}"), _Q1 + "lo_orderdate BETWEEN 19960101 AND 19970101 AND lo_discount BETWEEN 1 AND 3 AND lo_quantity < 25")
_add("ssb_q12", _q1("lo_discount BETWEEN 4 AND 6 AND lo_quantity BETWEEN 26 AND 35", days("1997-01-01", "1997-02-01"), f"{in_range('l_discount', 0.035, 0.065)} AND {in_range('l_quantity', 26, 36)}"), _Q1 + "lo_orderdate BETWEEN 19970101 AND 19970131 AND lo_discount BETWEEN 4 AND 6 AND lo_quantity BETWEEN 26 AND 35")
_add("ssb_q13", _q1("lo_discount BETWEEN 5 AND 7 AND lo_quantity BETWEEN 26 AND 35", days("1997-02-04", "1997-02-11"), f"{in_range('l_discount', 0.045, 0.075)} AND {in_range('l_quantity', 26, 36)}"), _Q1 + "lo_orderdate BETWEEN 19970204 AND 19970210 AND lo_discount BETWEEN 5 AND 7 AND lo_quantity BETWEEN 26 AND 35")


def _q2(part: str, region: int) -> Callable[[Star], DataFrame]:
    def build(s: Star) -> DataFrame:
        j = s.joined([Dim(s.supplier, "s_suppkey", "lo_suppkey", f"s_region = {region}"), Dim(s.part, "p_partkey", "lo_partkey", part, ["p_brand1"]), Dim(s.ddate, "d_datekey", "lo_orderdate", None, ["d_year"])])
        return j.groupBy("d_year", "p_brand1").agg(F.sum("lo_revenue").alias("revenue")).select("revenue", "d_year", "p_brand1").orderBy("d_year", "p_brand1")

    return build


def _q2_sql(where: str) -> str:
    return f"SELECT CAST(sum(lo_revenue) AS BIGINT) AS revenue, d_year, p_brand1 FROM lineorder, ddate, s_part, s_supplier WHERE lo_orderdate = d_datekey AND lo_partkey = p_partkey AND lo_suppkey = s_suppkey AND {where} GROUP BY d_year, p_brand1 ORDER BY d_year, p_brand1"


_add("ssb_q21", _q2("p_category = 1", 1), _q2_sql("p_category = 1 AND s_region = 1"))
_add("ssb_q22", _q2("p_brand1 BETWEEN 260 AND 267", 2), _q2_sql("p_brand1 BETWEEN 260 AND 267 AND s_region = 2"))
_add("ssb_q23", _q2("p_brand1 = 260", 3), _q2_sql("p_brand1 = 260 AND s_region = 3"))


def _q3(level: str, customer: str, supplier: str, date: str, when: str) -> Callable[[Star], DataFrame]:
    def build(s: Star) -> DataFrame:
        j = s.joined([Dim(s.customer, "c_custkey", "lo_custkey", customer, [f"c_{level}"]), Dim(s.supplier, "s_suppkey", "lo_suppkey", supplier, [f"s_{level}"]), Dim(s.ddate, "d_datekey", "lo_orderdate", date, ["d_year"])], None, when)
        return j.groupBy(f"c_{level}", f"s_{level}", "d_year").agg(F.sum("lo_revenue").alias("revenue")).orderBy("d_year", c("revenue").desc())

    return build


def _q3_sql(level: str, where: str) -> str:
    return f"SELECT c_{level}, s_{level}, d_year, CAST(sum(lo_revenue) AS BIGINT) AS revenue FROM lineorder, s_customer, s_supplier, ddate WHERE lo_custkey = c_custkey AND lo_suppkey = s_suppkey AND lo_orderdate = d_datekey AND {where} GROUP BY c_{level}, s_{level}, d_year ORDER BY d_year, revenue DESC"


_YEARS = _YEARS_SQL = "d_year BETWEEN 1995 AND 2000"
_WHEN = days("1995-01-01", "2001-01-01")
_CITY = lambda x: f"{x}_city IN (25, 65)"
_add("ssb_q31", _q3("nation", "c_region = 2", "s_region = 2", _YEARS, _WHEN), _q3_sql("nation", f"c_region = 2 AND s_region = 2 AND {_YEARS_SQL}"))
_add("ssb_q32", _q3("city", "c_nation = 24", "s_nation = 24", _YEARS, _WHEN), _q3_sql("city", f"c_nation = 24 AND s_nation = 24 AND {_YEARS_SQL}"))
_add("ssb_q33", _q3("city", _CITY("c"), _CITY("s"), _YEARS, _WHEN), _q3_sql("city", f"c_city IN (25, 65) AND s_city IN (25, 65) AND {_YEARS_SQL}"))
_add("ssb_q34", _q3("city", _CITY("c"), _CITY("s"), "d_yearmonthnum = 200012", days("2000-12-01", "2001-01-01")), _q3_sql("city", "c_city IN (25, 65) AND s_city IN (25, 65) AND d_yearmonthnum = 200012"))


def _q4(keys: list[str], customer: str, supplier: str, part: str, date: str | None, count: bool = False, name: str = "profit") -> Callable[[Star], DataFrame]:
    def build(s: Star) -> DataFrame:
        own = lambda x: [k for k in keys if k.startswith(x)]
        cost = [] if count else ["p_supplycost"]
        when = days("2000-01-01", "2002-01-01") if date == _LATE else None
        j = s.joined([Dim(s.customer, "c_custkey", "lo_custkey", customer, own("c_")), Dim(s.supplier, "s_suppkey", "lo_suppkey", supplier, own("s_")), Dim(s.part, "p_partkey", "lo_partkey", part, own("p_") + cost), Dim(s.ddate, "d_datekey", "lo_orderdate", date, own("d_"))], None, when)
        value = F.count(F.lit(1)) if count else F.sum(c("lo_revenue") - c("p_supplycost"))
        return j.groupBy(*keys).agg(value.alias(name)).orderBy(*keys)

    return build


def _q4_sql(keys: str, where: str, value: str = "CAST(sum(lo_revenue - lo_supplycost) AS BIGINT) AS profit") -> str:
    return f"SELECT {keys}, {value} FROM lineorder, ddate, s_customer, s_supplier, s_part WHERE lo_custkey = c_custkey AND lo_suppkey = s_suppkey AND lo_partkey = p_partkey AND lo_orderdate = d_datekey AND {where} GROUP BY {keys} ORDER BY {keys}"


_LATE = "d_year IN (2000, 2001)"
_add("ssb_q41", _q4(["d_year", "c_nation"], "c_region = 1", "s_region = 1", "p_mfgr IN (0, 1)", None), _q4_sql("d_year, c_nation", "c_region = 1 AND s_region = 1 AND p_mfgr IN (0, 1)"))
_add("ssb_q42", _q4(["d_year", "s_nation", "p_category"], "c_region = 1", "s_region = 1", "p_mfgr IN (0, 1)", _LATE), _q4_sql("d_year, s_nation, p_category", "c_region = 1 AND s_region = 1 AND p_mfgr IN (0, 1) AND d_year IN (2000, 2001)"))
_add("ssb_q43", _q4(["d_year", "s_city", "p_brand1"], "c_region = 1", "s_nation = 24", "p_category = 3", _LATE), _q4_sql("d_year, s_city, p_brand1", "c_region = 1 AND s_nation = 24 AND p_category = 3 AND d_year IN (2000, 2001)"))
_add("ssb_p1", _q4(["d_year", "c_nation"], "c_region = 1", "s_region = 1", "p_mfgr IN (0, 1)", None, True, "cnt"), _q4_sql("d_year, c_nation", "c_region = 1 AND s_region = 1 AND p_mfgr IN (0, 1)", "count(*) AS cnt"))
_add("default_query", lambda s: s.joined([Dim(s.part, "p_partkey", "lo_partkey"), Dim(s.supplier, "s_suppkey", "lo_suppkey"), Dim(s.ddate, "d_datekey", "lo_orderdate")]).agg(F.sum("lo_revenue").alias("revenue")), "SELECT CAST(sum(lo_revenue) AS BIGINT) AS revenue FROM lineorder, ddate, s_part, s_supplier WHERE lo_orderdate = d_datekey AND lo_partkey = p_partkey AND lo_suppkey = s_suppkey")
