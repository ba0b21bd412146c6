"""Star-schema views over the TPC-H-like tables, and the same views as SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.star_join import Dim, star_join

#: Tables of the warehouse that the star is made of.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


#: Most nations that are taken as a literal.
NATIONS = 1024


def in_range(column: str, lo: float | None = None, hi: float | None = None) -> str:
    """lo <= column < hi on a raw column: a condition that Parquet can skip row groups by, beside the exact one on what is made of it."""
    return " AND ".join(f"{column} {op} {float(v)}D" for op, v in ((">=", lo), ("<", hi)) if v is not None)


def days(first: str, end: str) -> str:
    """first <= o_orderdate < end, for Parquet as well."""
    return f"o_orderdate >= TIMESTAMP_NTZ'{first} 00:00:00' AND o_orderdate < TIMESTAMP_NTZ'{end} 00:00:00'"


class Star:
    """lineorder and its dimensions for one data directory; each is built only when used.

    Every line has its order and every key of a dimension is unique, as in any star
    schema: lines() therefore reads no orders, and queries that need nothing of an
    order don't join them.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, hints: bool = True):
        """hints: False for views, as Spark reorders no joins that have hints: places are then looked up in a literal."""
        self.spark, self.dir, self.hints = spark, sf_dir, hints

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sized(self, name: str, dim: DataFrame) -> DataFrame:
        """dim, which is made of the table name, to be broadcast if that table's files are under Spark's own threshold.

        Spark takes a join for as large as the product of its sides, so it would not
        see that a dimension with its nation is small. A larger one is shuffled, or
        broadcast by its real size at run time.
        """
        if not self.hints:
            return dim
        limit = int(self.spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
        size = int(str(self.raw(name)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return F.broadcast(dim) if size <= limit else dim

    def table(self, name: str) -> DataFrame:
        """A view of the star, or else a table of the warehouse, by its name."""
        views = {"lineorder": lambda: self.lineorder_cost, "ddate": lambda: self.ddate, "part": lambda: self.part, "supplier": lambda: self.supplier, "customer": lambda: self.customer}
        if name in views:
            return views[name]()
        if name in TABLES:
            return self.raw(name)
        raise KeyError(f"no table {name}")

    def lines(self, where: str | None = None) -> DataFrame:
        """The columns of lineorder that a line has itself."""
        price, off = F.round(F.col("l_extendedprice") * 100).cast("long"), F.round(F.col("l_discount") * 100).cast("int")
        line = self.raw("lineitem")
        return (line if where is None else line.where(where)).select(
            F.col("l_orderkey").alias("lo_orderkey"),
            F.col("l_linenumber").alias("lo_linenumber"),
            F.col("l_partkey").alias("lo_partkey"),
            F.col("l_suppkey").alias("lo_suppkey"),
            F.col("l_quantity").cast("int").alias("lo_quantity"),
            price.alias("lo_extendedprice"),
            off.alias("lo_discount"),
            F.round(F.col("l_tax") * 100).cast("int").alias("lo_tax"),
            F.floor(price * (100 - off) / 100).cast("long").alias("lo_revenue"),
        )

    def orders(self, where: str | None = None) -> DataFrame:
        """The columns of lineorder that come from the order."""
        day, orders = F.col("o_orderdate"), self.raw("orders")
        return (orders if where is None else orders.where(where)).select("o_orderkey", F.col("o_custkey").alias("lo_custkey"), (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).alias("lo_orderdate"))

    def joined(self, dims: list[Dim], lines: str | None = None, orders: str | None = None, exact: str | None = None) -> DataFrame:
        """Lines and orders, each filtered by its own dimensions and conditions before the two meet.

        lines, orders: conditions on raw columns; exact: one on lineorder's own columns of a line.
        """
        line = self.lines(lines)
        line = line if exact is None else line.where(exact)
        of_line = [d for d in dims if d.foreign in line.columns]
        of_order = [d for d in dims if d.foreign not in line.columns]
        line = star_join(line, of_line)
        if not of_order and orders is None:
            return line
        order = star_join(self.orders(orders), of_order)
        on = F.col("lo_orderkey") == F.col("o_orderkey")
        if any(d.columns or not d.unique for d in of_order):
            return line.join(order, on).drop("o_orderkey")
        return line.join(order.select("o_orderkey"), on, "left_semi")

    @cached_property
    def lineorder(self) -> DataFrame:
        return self.lines().join(self.orders(), F.col("lo_orderkey") == F.col("o_orderkey")).drop("o_orderkey")

    @cached_property
    def lineorder_cost(self) -> DataFrame:
        """lineorder with lo_supplycost, which needs the part's price."""
        return self.lines_cost().join(self.orders(), F.col("lo_orderkey") == F.col("o_orderkey")).drop("o_orderkey")

    def lines_cost(self) -> DataFrame:
        return self.lines().join(self.part.select(F.col("p_partkey").alias("lo_partkey"), F.col("p_supplycost").alias("lo_supplycost")), "lo_partkey")

    @cached_property
    def ddate(self) -> DataFrame:
        days = self.spark.range(1).select(F.explode(F.sequence(F.lit("1995-01-01").cast("date"), F.lit("2001-12-31").cast("date"))).alias("d"))
        y, m = F.year("d"), F.month("d")
        days = days.select((y * 10000 + m * 100 + F.dayofmonth("d")).alias("d_datekey"), y.alias("d_year"), (y * 100 + m).alias("d_yearmonthnum"))
        return F.broadcast(days) if self.hints else days  # a row for each day of seven years

    @cached_property
    def part(self) -> DataFrame:
        b = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
        part = self.raw("part").select(
            "p_partkey",
            F.floor((b - 1) / 5).cast("int").alias("p_mfgr"),
            (b - 1).alias("p_category"),
            ((b - 1) * 40 + (F.col("p_size") - 1) % 40).cast("int").alias("p_brand1"),
            "p_size",
            F.floor(F.round(F.col("p_retailprice") * 100).cast("long") * 6 / 10).cast("long").alias("p_supplycost"),
        )
        return self.sized("part", part)

    def nations(self, *columns: str) -> dict[int, tuple] | None:
        """Those columns of each nation by its key; None beyond NATIONS rows."""
        nation = self.raw("nation").join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        rows = nation.select("n_nationkey", *columns).limit(NATIONS + 1).collect()
        return {r[0]: tuple(r)[1:] for r in rows} if len(rows) <= NATIONS else None

    def with_nation(self, table: str, x: str, columns: dict[str, str]) -> DataFrame:
        """table with columns of its nation under new names (column: name), its rows without a nation left out."""
        t = self.raw(table)
        known = None if self.hints else self.nations(*columns)
        if known:
            look = lambda i: F.element_at(F.create_map(*(F.lit(v) for k, row in known.items() for v in (k, row[i]))), F.col(f"{x}_nationkey"))
            return t.where(F.col(f"{x}_nationkey").isin(list(known))).select("*", *(look(i).alias(name) for i, name in enumerate(columns.values())))
        nation = self.raw("nation").join(F.broadcast(self.raw("region")), F.col("n_regionkey") == F.col("r_regionkey")) if {"n_name", "r_name"} & set(columns) else self.raw("nation")
        nation = nation.select(F.col("n_nationkey").alias("nation_"), *(F.col(k).alias(v) for k, v in columns.items()))
        return t.join(F.broadcast(nation), F.col(f"{x}_nationkey") == F.col("nation_")).drop("nation_")  # 25 rows at any scale

    def _place(self, table: str, x: str) -> DataFrame:
        t = self.with_nation(table, x, {"n_regionkey": f"{x}_region"}).withColumn(f"{x}_nation", F.col(f"{x}_nationkey"))
        key = f"{x}_custkey" if x == "c" else f"{x}_suppkey"
        return self.sized(table, t.select(key, f"{x}_nation", f"{x}_region", (F.col(f"{x}_nation") * 10 + F.col(key) % 10).cast("int").alias(f"{x}_city")))

    @cached_property
    def supplier(self) -> DataFrame:
        return self._place("supplier", "s")

    @cached_property
    def customer(self) -> DataFrame:
        return self._place("customer", "c")


#: The views as common table expressions.
SQL_VIEWS = r"""
WITH lineorder AS (
  SELECT l_orderkey AS lo_orderkey, l_linenumber AS lo_linenumber, o_custkey AS lo_custkey, l_partkey AS lo_partkey, l_suppkey AS lo_suppkey,
    CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS INTEGER) AS lo_orderdate,
    CAST(l_quantity AS INTEGER) AS lo_quantity, CAST(round(l_extendedprice * 100) AS BIGINT) AS lo_extendedprice,
    CAST(round(l_discount * 100) AS INTEGER) AS lo_discount, CAST(round(l_tax * 100) AS INTEGER) AS lo_tax,
    (CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS INTEGER))) // 100 AS lo_revenue,
    (CAST(round(p_retailprice * 100) AS BIGINT) * 6) // 10 AS lo_supplycost
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
ddate AS (
  SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS d_datekey, CAST(year(d) AS INTEGER) AS d_year, CAST(year(d) * 100 + month(d) AS INTEGER) AS d_yearmonthnum
  FROM (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS d)),
s_part AS (
  SELECT p_partkey, CAST((b - 1) // 5 AS INTEGER) AS p_mfgr, CAST(b - 1 AS INTEGER) AS p_category, CAST((b - 1) * 40 + (p_size - 1) % 40 AS INTEGER) AS p_brand1, p_size
  FROM (SELECT p_partkey, p_size, CAST(regexp_extract(p_brand, '(\d+)', 1) AS INTEGER) AS b FROM part)),
s_supplier AS (
  SELECT s_suppkey, n_nationkey AS s_nation, n_regionkey AS s_region, CAST(n_nationkey * 10 + s_suppkey % 10 AS INTEGER) AS s_city FROM supplier JOIN nation ON s_nationkey = n_nationkey),
s_customer AS (
  SELECT c_custkey, n_nationkey AS c_nation, n_regionkey AS c_region, CAST(n_nationkey * 10 + c_custkey % 10 AS INTEGER) AS c_city FROM customer JOIN nation ON c_nationkey = n_nationkey)
"""
