"""One small query for each relational operator: scans, filters, projections, joins, aggregates and order."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import SQL_VIEWS, TABLES, Star
from ..functions.arithmetic import div, mul, sum0
from ..operators.star_join import Dim, star_join
from ..sources import column_files, delimited, text_sink

c = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_SUM = "CAST(sum(lo_revenue) AS BIGINT) AS revenue"
_BY_YEAR = "lineorder JOIN ddate ON lo_orderdate = d_datekey"


def _add(name: str, sql: str | None, build: Callable[[Star], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(Star(spark, sf_dir))
    if sql:
        SQL[name] = SQL_VIEWS + sql


def _revenue(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("lo_revenue").alias("revenue"))


def _dated(s: Star, *extra: Dim) -> DataFrame:
    return s.joined([Dim(s.ddate, "d_datekey", "lo_orderdate", None, ["d_year"]), *extra])


_sup = lambda s, where=None, cols=(): Dim(s.supplier, "s_suppkey", "lo_suppkey", where, list(cols))
_cus = lambda s, where=None, cols=(): Dim(s.customer, "c_custkey", "lo_custkey", where, list(cols))
_par = lambda s, where=None, cols=(): Dim(s.part, "p_partkey", "lo_partkey", where, list(cols))



def _having(s: Star) -> DataFrame:
    """Years of more than the mean revenue of seven years, by a scalar that is joined: one row on its side."""
    every = s.lines().agg(F.sum("lo_revenue").alias("every"))
    return _revenue(_dated(s), "d_year").join(F.broadcast(every), c("revenue") * 7 > c("every")).drop("every")


# scans
_add("scan_full", "SELECT * FROM supplier", lambda s: s.raw("supplier"))
_add("scan_projection", "SELECT lo_orderkey, lo_revenue FROM lineorder", lambda s: s.lines().select("lo_orderkey", "lo_revenue"))
_add("count_rows", "SELECT count(*) AS cnt FROM lineorder WHERE lo_quantity < 25", lambda s: s.lines().where(c("lo_quantity") < 25).agg(F.count(F.lit(1)).alias("cnt")))
_add("agg_minmax_stats", "SELECT min(lo_orderdate) AS lo, max(lo_orderdate) AS hi FROM lineorder", lambda s: s.lineorder.agg(F.min("lo_orderdate").alias("lo"), F.max("lo_orderdate").alias("hi")))

# filters
for _name, _op in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    _add(f"filter_{_name}", f"SELECT lo_orderkey, lo_discount FROM lineorder WHERE lo_discount {_op} 5", lambda s, op=_op: s.lines().where(f"lo_discount {op} 5").select("lo_orderkey", "lo_discount"))
_add("filter_col_col", "SELECT lo_orderkey, lo_revenue FROM lineorder WHERE lo_supplycost * 10 < lo_revenue", lambda s: s.lines_cost().where(mul("lo_supplycost", 10) < c("lo_revenue")).select("lo_orderkey", "lo_revenue"))
_pick = lambda s, cond, *cols: s.lines().where(cond).select("lo_orderkey", *cols)
_add("filter_and", "SELECT lo_orderkey, lo_discount FROM lineorder WHERE lo_discount >= 5 AND lo_quantity < 10", lambda s: _pick(s, (c("lo_discount") >= 5) & (c("lo_quantity") < 10), "lo_discount"))
_add("filter_or", "SELECT lo_orderkey, lo_discount FROM lineorder WHERE lo_discount >= 5 OR lo_quantity < 10", lambda s: _pick(s, (c("lo_discount") >= 5) | (c("lo_quantity") < 10), "lo_discount"))
_add("filter_nested_or", "SELECT lo_orderkey, lo_discount, lo_orderdate FROM lineorder WHERE lo_quantity < 10 AND (lo_discount = 1 OR lo_orderdate >= 20000101)", lambda s: s.lineorder.where((c("lo_quantity") < 10) & ((c("lo_discount") == 1) | (c("lo_orderdate") >= 20000101))).select("lo_orderkey", "lo_discount", "lo_orderdate"))
_add("filter_between", "SELECT lo_orderkey, lo_discount FROM lineorder WHERE lo_discount BETWEEN 4 AND 6", lambda s: _pick(s, c("lo_discount").between(4, 6), "lo_discount"))
_add("filter_half_open", "SELECT lo_orderkey, lo_discount FROM lineorder WHERE lo_discount > 4 AND lo_discount <= 6", lambda s: _pick(s, (c("lo_discount") > 4) & (c("lo_discount") <= 6), "lo_discount"))
_add("filter_in", "SELECT p_partkey, p_mfgr FROM s_part WHERE p_mfgr IN (0, 1)", lambda s: s.part.where(c("p_mfgr").isin(0, 1)).select("p_partkey", "p_mfgr"))
_add("filter_in_many", "SELECT p_partkey, p_mfgr FROM s_part WHERE p_mfgr IN (0, 2, 4)", lambda s: s.part.where(c("p_mfgr").isin(0, 2, 4)).select("p_partkey", "p_mfgr"))
_add("filter_not", "SELECT lo_orderkey, lo_discount FROM lineorder WHERE NOT (lo_discount >= 5)", lambda s: _pick(s, ~(c("lo_discount") >= 5), "lo_discount"))
_left = "(SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey)"
_add("filter_is_not_null", f"SELECT o_orderkey, l_linenumber FROM {_left} WHERE l_linenumber IS NOT NULL", lambda s: _lines(s, "left").where(c("l_linenumber").isNotNull()).select("o_orderkey", "l_linenumber"))
_add("filter_is_null", f"SELECT o_orderkey FROM {_left} WHERE l_linenumber IS NULL", lambda s: _lines(s, "left").where(c("l_linenumber").isNull()).select("o_orderkey"))
_add("filter_like", "SELECT p_partkey, p_type FROM part WHERE p_brand LIKE 'Brand#1%'", lambda s: s.raw("part").where(c("p_brand").like("Brand#1%")).select("p_partkey", "p_type"))
_add("filter_expr", "SELECT lo_orderkey, lo_quantity FROM lineorder WHERE lo_quantity + lo_discount > 55", lambda s: _pick(s, c("lo_quantity") + c("lo_discount") > 55, "lo_quantity"))
_add("filter_after_join", "SELECT lo_orderkey, s_nation FROM lineorder JOIN s_supplier ON lo_suppkey = s_suppkey WHERE lo_quantity < 10 AND s_region = 1", lambda s: s.joined([_sup(s, None, ["s_nation", "s_region"])]).where(c("lo_quantity") < 10).where(c("s_region") == 1).select("lo_orderkey", "s_nation"))
_add("having_group_key", f"SELECT d_year, {_SUM} FROM {_BY_YEAR} GROUP BY d_year HAVING d_year >= 1998", lambda s: _revenue(_dated(s), "d_year").where(c("d_year") >= 1998))
_add("having_agg", f"SELECT d_year, {_SUM} FROM {_BY_YEAR} GROUP BY d_year HAVING sum(lo_revenue) * 7 > (SELECT sum(lo_revenue) FROM lineorder)", _having)

# projections
_v = lambda f, cost=False: lambda s: (s.lines_cost() if cost else s.lines()).select(f().alias("v"))
_add("project_reorder", "SELECT lo_revenue, lo_orderkey FROM lineorder", lambda s: s.lines().select("lo_revenue", "lo_orderkey"))
_add("project_literal", "SELECT lo_orderkey, 7 AS k FROM lineorder", lambda s: s.lines().select("lo_orderkey", F.lit(7).alias("k")))
_add("project_mul", "SELECT lo_extendedprice * lo_discount AS v FROM lineorder", _v(lambda: mul("lo_extendedprice", "lo_discount")))
_add("project_sub", "SELECT lo_revenue - lo_supplycost AS v FROM lineorder", _v(lambda: c("lo_revenue") - c("lo_supplycost"), True))
_add("project_add", "SELECT lo_quantity + lo_discount AS v FROM lineorder", _v(lambda: c("lo_quantity") + c("lo_discount")))
_add("project_lit_first", "SELECT 100 - lo_discount AS v FROM lineorder", _v(lambda: 100 - c("lo_discount")))
_add("project_lit_second", "SELECT lo_quantity + 1 AS v FROM lineorder", _v(lambda: c("lo_quantity") + 1))
_add("project_int_div", "SELECT CAST(lo_extendedprice // lo_quantity AS BIGINT) AS v FROM lineorder", _v(lambda: div("lo_extendedprice", "lo_quantity")))
_add("project_nested", "SELECT lo_extendedprice * (100 - lo_discount) + lo_tax AS v FROM lineorder", _v(lambda: mul("lo_extendedprice", 100 - c("lo_discount")) + c("lo_tax")))
_add("project_agg_arithmetic", "SELECT d_year, CAST(sum(lo_revenue) AS BIGINT) // 100 AS v FROM lineorder JOIN ddate ON lo_orderdate = d_datekey GROUP BY d_year", lambda s: _revenue(_dated(s), "d_year").select("d_year", div("revenue", F.lit(100)).alias("v")))
_add("select_filter_project", "SELECT lo_orderkey, lo_revenue FROM lineorder WHERE lo_discount = 10", lambda s: _pick(s, c("lo_discount") == 10, "lo_revenue"))

# joins
_semi = f"SELECT {_SUM} FROM lineorder WHERE lo_suppkey IN (SELECT s_suppkey FROM s_supplier WHERE s_region = 1)"
_add("join_semi", _semi, lambda s: s.lines().join(s.supplier.where("s_region = 1"), c("lo_suppkey") == c("s_suppkey"), "left_semi").agg(F.sum("lo_revenue").alias("revenue")))
_add("join_semi_rewrite", f"SELECT {_SUM} FROM lineorder JOIN s_supplier ON lo_suppkey = s_suppkey WHERE s_region = 1", lambda s: s.joined([_sup(s, c("s_region") == 1)]).agg(F.sum("lo_revenue").alias("revenue")))
_add("join_inner", f"SELECT d_year, {_SUM} FROM {_BY_YEAR} GROUP BY d_year", lambda s: _revenue(_dated(s), "d_year"))
_add("join_star_2dim", f"SELECT d_year, {_SUM} FROM {_BY_YEAR} JOIN s_supplier ON lo_suppkey = s_suppkey WHERE s_region = 2 GROUP BY d_year", lambda s: _revenue(_dated(s, _sup(s, c("s_region") == 2)), "d_year"))
_add("join_star_3dim", f"SELECT d_year, c_nation, {_SUM} FROM {_BY_YEAR} JOIN s_supplier ON lo_suppkey = s_suppkey JOIN s_customer ON lo_custkey = c_custkey WHERE s_region = 2 AND c_region = 1 GROUP BY d_year, c_nation", lambda s: _revenue(_dated(s, _sup(s, c("s_region") == 2), _cus(s, c("c_region") == 1, ["c_nation"])), "d_year", "c_nation"))
_add("join_star_4dim", f"SELECT d_year, c_nation, p_category, {_SUM} FROM {_BY_YEAR} JOIN s_supplier ON lo_suppkey = s_suppkey JOIN s_customer ON lo_custkey = c_custkey JOIN s_part ON lo_partkey = p_partkey WHERE s_region = 2 AND c_region = 1 AND p_mfgr = 0 GROUP BY d_year, c_nation, p_category", lambda s: _revenue(_dated(s, _sup(s, c("s_region") == 2), _cus(s, c("c_region") == 1, ["c_nation"]), _par(s, c("p_mfgr") == 0, ["p_category"])), "d_year", "c_nation", "p_category"))
_add("join_snowflake", "SELECT r_name, count(*) AS cnt FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", lambda s: s.raw("supplier").join(s.raw("nation"), c("s_nationkey") == c("n_nationkey")).join(s.raw("region"), c("n_regionkey") == c("r_regionkey")).groupBy("r_name").agg(F.count(F.lit(1)).alias("cnt")))
# customers with whole orders (those without any stay in outer and anti joins), orders with whole lines
_cust = lambda s, how: s.customer.select("c_custkey").join(s.raw("orders").select("o_custkey", "o_orderkey"), c("c_custkey") == c("o_custkey"), how)
for _name, _how, _sql in (("left", "left", "LEFT"), ("full", "full", "FULL")):
    _add(f"join_{_name}", f"SELECT c_custkey, o_orderkey FROM s_customer {_sql} JOIN orders ON c_custkey = o_custkey", lambda s, how=_how: _cust(s, how).select("c_custkey", "o_orderkey"))
_add("join_right", "SELECT l_orderkey, l_linenumber, o_orderkey FROM lineitem RIGHT JOIN orders ON l_orderkey = o_orderkey", lambda s: s.raw("lineitem").select("l_orderkey", "l_linenumber").join(s.raw("orders").select("o_orderkey"), c("l_orderkey") == c("o_orderkey"), "right"))
_add("join_anti", "SELECT c_custkey FROM s_customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')", lambda s: s.customer.join(s.raw("orders").where("o_orderpriority = '1-URGENT'"), c("c_custkey") == c("o_custkey"), "left_anti").select("c_custkey"))  # customers without an urgent order
# some orders have no lines
_lines = lambda s, how: s.raw("orders").select("o_orderkey").join(s.raw("lineitem").select("l_orderkey", "l_linenumber"), c("o_orderkey") == c("l_orderkey"), how)
for _name, _how, _sql in (("left", "left", "LEFT"), ("right", "right", "RIGHT"), ("full", "full", "FULL")):
    _add(f"join_{_name}_whole", f"SELECT o_orderkey, l_orderkey, l_linenumber FROM orders {_sql} JOIN lineitem ON o_orderkey = l_orderkey", lambda s, how=_how: _lines(s, how))
_add("join_anti_whole", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)", lambda s: _lines(s, "left_anti"))
_add("join_multi_key", "SELECT count(*) AS cnt FROM s_supplier JOIN s_customer ON s_nation = c_nation AND s_city = c_city", lambda s: s.supplier.join(s.customer, (c("s_nation") == c("c_nation")) & (c("s_city") == c("c_city"))).agg(F.count(F.lit(1)).alias("cnt")))
_add("join_theta", "SELECT a.r_regionkey AS lo, b.r_regionkey AS hi FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey", lambda s: s.raw("region").select(c("r_regionkey").alias("lo")).join(s.raw("region").select(c("r_regionkey").alias("hi")), c("lo") < c("hi")))
_add("join_dim_measure", "SELECT p_category, CAST(sum(p_size) AS BIGINT) AS size FROM lineorder JOIN s_part ON lo_partkey = p_partkey GROUP BY p_category", lambda s: s.joined([_par(s, None, ["p_category", "p_size"])]).groupBy("p_category").agg(F.sum("p_size").alias("size")))

_add("join_cross", "SELECT r_name, p_mfgr, count(*) AS cnt FROM region, (SELECT DISTINCT p_mfgr FROM s_part) GROUP BY r_name, p_mfgr", lambda s: s.raw("region").select("r_name").crossJoin(F.broadcast(s.part.select("p_mfgr").distinct())).groupBy("r_name", "p_mfgr").agg(F.count(F.lit(1)).alias("cnt")))  # five rows on each side


def _reduced(s: Star) -> DataFrame:
    """A selective dimension of the orders reduces the lines by a semi join before they meet anything else; Spark adds a Bloom filter of its own where it pays."""
    few = star_join(s.orders("o_orderdate >= TIMESTAMP_NTZ'2001-07-01 00:00:00'"), [_cus(s, "c_nation = 24")]).select("o_orderkey")
    line = s.lines().join(few, c("lo_orderkey") == c("o_orderkey"), "left_semi")
    return star_join(line, [_par(s, None, ["p_category"])]).groupBy("p_category").agg(F.sum("lo_revenue").alias("revenue"))


_add("join_semi_reducer", f"SELECT p_category, {_SUM} FROM lineorder JOIN s_customer ON lo_custkey = c_custkey JOIN s_part ON lo_partkey = p_partkey WHERE c_nation = 24 AND lo_orderdate >= 20010701 GROUP BY p_category", _reduced)

# aggregates
_none = "lo_quantity < 0"
_add("agg_sum_global", f"SELECT {_SUM} FROM lineorder", lambda s: s.lines().agg(F.sum("lo_revenue").alias("revenue")))
_add("agg_sum_empty", f"SELECT {_SUM} FROM lineorder WHERE lo_quantity < 0", lambda s: s.lines().where(_none).agg(F.sum("lo_revenue").alias("revenue")))
_add("agg_sum0", "SELECT CAST(coalesce(sum(lo_revenue), 0) AS BIGINT) AS revenue FROM lineorder WHERE lo_quantity < 0", lambda s: s.lines().where(_none).agg(sum0("lo_revenue").alias("revenue")))
_add("agg_group_1key", f"SELECT d_year, {_SUM} FROM {_BY_YEAR} GROUP BY d_year", lambda s: _revenue(_dated(s), "d_year"))
_PART = f"{_BY_YEAR} JOIN s_part ON lo_partkey = p_partkey"
_add("agg_group_2key", f"SELECT d_year, p_category, {_SUM} FROM {_PART} GROUP BY d_year, p_category", lambda s: _revenue(_dated(s, _par(s, None, ["p_category"])), "d_year", "p_category"))
_add("agg_group_3key", f"SELECT d_year, p_category, s_nation, {_SUM} FROM {_PART} JOIN s_supplier ON lo_suppkey = s_suppkey GROUP BY d_year, p_category, s_nation", lambda s: _revenue(_dated(s, _par(s, None, ["p_category"]), _sup(s, None, ["s_nation"])), "d_year", "p_category", "s_nation"))
_add("agg_sum_expr", f"SELECT d_year, CAST(sum(lo_extendedprice * lo_discount) AS BIGINT) AS revenue FROM {_BY_YEAR} GROUP BY d_year", lambda s: _dated(s).groupBy("d_year").agg(F.sum(mul("lo_extendedprice", "lo_discount")).alias("revenue")))
_add("agg_group_fact_key", f"SELECT lo_discount, {_SUM} FROM lineorder GROUP BY lo_discount", lambda s: _revenue(s.lines(), "lo_discount"))
_add("agg_two_keys_one_dim", f"SELECT c_nation, c_city, {_SUM} FROM lineorder JOIN s_customer ON lo_custkey = c_custkey GROUP BY c_nation, c_city", lambda s: _revenue(s.joined([_cus(s, None, ["c_nation", "c_city"])]), "c_nation", "c_city"))
_add("group_by_expr", f"SELECT lo_quantity % 10 AS k, {_SUM} FROM lineorder GROUP BY lo_quantity % 10", lambda s: s.lines().groupBy((c("lo_quantity") % 10).alias("k")).agg(F.sum("lo_revenue").alias("revenue")))
_n, _avg = lambda: F.count(F.lit(1)).alias("cnt"), lambda: F.round(F.avg("lo_quantity"), 6).alias("mean")
_add("agg_count", f"SELECT d_year, count(*) AS cnt FROM {_BY_YEAR} GROUP BY d_year", lambda s: _dated(s).groupBy("d_year").agg(_n()))
_add("agg_avg", f"SELECT d_year, round(avg(lo_quantity), 6) AS mean FROM {_BY_YEAR} GROUP BY d_year", lambda s: _dated(s).groupBy("d_year").agg(_avg()))
_add("agg_multi", f"SELECT d_year, count(*) AS cnt, round(avg(lo_quantity), 6) AS mean, {_SUM} FROM {_BY_YEAR} GROUP BY d_year", lambda s: _dated(s).groupBy("d_year").agg(_n(), _avg(), F.sum("lo_revenue").alias("revenue")))
_add("agg_count_distinct", f"SELECT d_year, count(DISTINCT lo_custkey) AS cnt FROM {_BY_YEAR} GROUP BY d_year", lambda s: _dated(s).groupBy("d_year").agg(F.count_distinct("lo_custkey").alias("cnt")))
_add("agg_distinct", "SELECT DISTINCT s_region, s_nation FROM s_supplier", lambda s: s.supplier.select("s_region", "s_nation").distinct())
_add("agg_min_max", f"SELECT d_year, min(lo_revenue) AS lo, max(lo_revenue) AS hi FROM {_BY_YEAR} GROUP BY d_year", lambda s: _dated(s).groupBy("d_year").agg(F.min("lo_revenue").alias("lo"), F.max("lo_revenue").alias("hi")))
_add("agg_rollup", f"SELECT s_region, s_nation, {_SUM} FROM lineorder JOIN s_supplier ON lo_suppkey = s_suppkey GROUP BY ROLLUP (s_region, s_nation)", lambda s: s.joined([_sup(s, None, ["s_region", "s_nation"])]).rollup("s_region", "s_nation").agg(F.sum("lo_revenue").alias("revenue")))
_add("agg_cube", f"SELECT s_region, lo_discount, {_SUM} FROM lineorder JOIN s_supplier ON lo_suppkey = s_suppkey GROUP BY CUBE (s_region, lo_discount)", lambda s: s.joined([_sup(s, None, ["s_region"])]).cube("s_region", "lo_discount").agg(F.sum("lo_revenue").alias("revenue")))

_add("agg_grouping_sets", f"SELECT s_region, lo_discount, {_SUM} FROM lineorder JOIN s_supplier ON lo_suppkey = s_suppkey GROUP BY GROUPING SETS ((s_region), (lo_discount), ())", lambda s: s.joined([_sup(s, None, ["s_region"])]).groupingSets([["s_region"], ["lo_discount"], []], "s_region", "lo_discount").agg(F.sum("lo_revenue").alias("revenue")))
_add("agg_stddev", "SELECT lo_discount, round(stddev_samp(lo_quantity), 6) AS sd, round(var_pop(lo_quantity), 6) AS vp FROM lineorder GROUP BY lo_discount", lambda s: s.lines().groupBy("lo_discount").agg(F.round(F.stddev_samp("lo_quantity"), 6).alias("sd"), F.round(F.var_pop("lo_quantity"), 6).alias("vp")))
_add("agg_sum_distinct", "SELECT lo_discount, CAST(sum(DISTINCT lo_quantity) AS BIGINT) AS total FROM lineorder GROUP BY lo_discount", lambda s: s.lines().groupBy("lo_discount").agg(F.sum_distinct("lo_quantity").alias("total")))

# order
_add("sort_asc_desc", f"SELECT d_year, lo_discount, {_SUM} FROM {_BY_YEAR} GROUP BY d_year, lo_discount ORDER BY d_year, revenue DESC", lambda s: _revenue(_dated(s), "d_year", "lo_discount").orderBy("d_year", c("revenue").desc()))
_add("sort_multi_key", "SELECT s_suppkey, s_region, s_nation FROM s_supplier ORDER BY s_region, s_nation DESC, s_suppkey", lambda s: s.supplier.select("s_suppkey", "s_region", "s_nation").orderBy("s_region", c("s_nation").desc(), "s_suppkey"))
_add("sort_nulls", "SELECT s_suppkey, nullif(s_nation, 3) AS n FROM s_supplier ORDER BY n NULLS LAST, s_suppkey", lambda s: s.supplier.select("s_suppkey", F.nullif("s_nation", F.lit(3)).alias("n")).orderBy(c("n").asc_nulls_last(), "s_suppkey"))
_add("topk", "SELECT lo_orderkey, lo_linenumber, lo_revenue, lo_partkey FROM lineorder ORDER BY lo_revenue DESC, lo_orderkey, lo_linenumber, lo_partkey LIMIT 10", lambda s: s.lines().select("lo_orderkey", "lo_linenumber", "lo_revenue", "lo_partkey").orderBy(c("lo_revenue").desc(), "lo_orderkey", "lo_linenumber", "lo_partkey").limit(10))
_add("sort_offset", "SELECT s_suppkey FROM s_supplier ORDER BY s_suppkey LIMIT 5 OFFSET 3", lambda s: s.supplier.select("s_suppkey").orderBy("s_suppkey").offset(3).limit(5))


def _sink(s: Star) -> DataFrame:
    from . import ssb

    return text_sink.round_trip(ssb.QUERIES["ssb_q21"](s.spark, s.dir))


_add("sink_text", "SELECT CAST(CAST(sum(lo_revenue) AS BIGINT) AS VARCHAR) || ' ' || d_year || ' ' || p_brand1 AS value FROM lineorder, ddate, s_part, s_supplier WHERE lo_orderdate = d_datekey AND lo_partkey = p_partkey AND lo_suppkey = s_suppkey AND p_category = 1 AND s_region = 1 GROUP BY d_year, p_brand1", _sink)


def _views(s: Star) -> DataFrame:
    """All tables of the warehouse as views, and how many rows each has."""
    from .. import sql

    sql.register(s.spark, s.dir)
    return sql.run(s.spark, " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS cnt FROM raw_{t}" for t in TABLES))


def _column_files(s: Star) -> DataFrame:
    folder = f"{text_sink.shared_dir(s.spark)}/columns-{uuid.uuid4().hex}"
    column_files.write_table(s.part.select("p_partkey", "p_mfgr", "p_category", "p_brand1"), folder, "part", "p_partkey", [0, 2, 3, 4])
    return column_files.read_table(s.spark, folder, "part", {0: "p_partkey", 2: "p_mfgr", 3: "p_category", 4: "p_brand1"})


def _csv(s: Star) -> DataFrame:
    """The suppliers as lines with | between and behind the values, read with a schema."""
    path = f"{text_sink.shared_dir(s.spark)}/csv-{uuid.uuid4().hex}"
    delimited.write(s.supplier, path)
    return delimited.read(s.spark, path, "s_suppkey BIGINT, s_nation INT, s_region INT, s_city INT")


_add("load_all_tables", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS cnt FROM {t}" for t in TABLES), _views)
_add("table_lookup", "SELECT c_custkey, c_city FROM s_customer", lambda s: s.table("customer").select("c_custkey", "c_city"))
_add("scan_column_files", "SELECT CAST(p_partkey AS INTEGER) AS p_partkey, p_mfgr, p_category, p_brand1 FROM s_part", _column_files)
_add("scan_csv", "SELECT s_suppkey, s_nation, s_region, s_city FROM s_supplier", _csv)
