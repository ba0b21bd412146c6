"""SQL front door: the star as views, single queries from text or files, suites of them with timings.

Two sets of views are made over one data directory: the coded one, in which places,
brands and dates are numbers, and the named one, in which they are text. The tables
of the warehouse are there too, under their own name behind raw_.
"""

from __future__ import annotations

import csv
import time
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import TABLES, Star

QUERIES = Path(__file__).parent / "queries"
VIEWS = ("lineorder", "ddate", "part", "supplier", "customer")
#: What is run if no file is named.
DEFAULT = "SELECT sum(lo_revenue) AS revenue FROM lineorder, ddate, part, supplier WHERE lo_orderdate = d_datekey AND lo_partkey = p_partkey AND lo_suppkey = s_suppkey"
HEADER = ("query", "repetition", "device", "total_ms", "plan_ms", "run_ms", "rows")


def _named_place(s: Star, table: str, x: str) -> DataFrame:
    key = "c_custkey" if x == "c" else "s_suppkey"
    t = s.with_nation(table, x, {"n_name": f"{x}_nation", "r_name": f"{x}_region"})
    city = F.concat(F.rpad(F.substring(f"{x}_nation", 1, 9), 9, " "), (F.col(key) % 10).cast("string"))
    return t.select(key, city.alias(f"{x}_city"), f"{x}_nation", f"{x}_region")


def named(s: Star) -> dict[str, DataFrame]:
    """The star with text for manufacturers, categories, brands, cities, nations, regions and months."""
    maker = F.concat(F.lit("MFGR#"), (F.col("p_mfgr") + 1).cast("string"))
    kind = F.concat(maker, (F.col("p_category") % 5 + 1).cast("string"))
    part = s.part.select("p_partkey", maker.alias("p_mfgr"), kind.alias("p_category"), F.concat(kind, (F.col("p_brand1") % 40 + 1).cast("string")).alias("p_brand1"), "p_size")
    day = F.to_date(F.col("d_datekey").cast("string"), "yyyyMMdd")
    dates = s.ddate.select("d_datekey", "d_year", "d_yearmonthnum", F.date_format(day, "MMMyyyy").alias("d_yearmonth"), F.floor((F.dayofyear(day) - 1) / 7 + 1).cast("int").alias("d_weeknuminyear"))
    return {"lineorder": s.lineorder_cost, "ddate": dates, "part": part, "supplier": _named_place(s, "supplier", "s"), "customer": _named_place(s, "customer", "c")}


def register(spark: SparkSession, data: str, names: str = "coded") -> Star:
    """Makes the views of the session. names: coded or named."""
    if names not in ("coded", "named"):
        raise ValueError(f"views are coded or named, not {names}")
    s = Star(spark, data, hints=False)
    for view, df in (named(s) if names == "named" else {v: s.table(v) for v in VIEWS}).items():
        df.createOrReplaceTempView(view)
    for t in TABLES:
        s.raw(t).createOrReplaceTempView(f"raw_{t}")
    return s


def load(path: str | None = None) -> str:
    """The query of a file, without comments at its head and the semicolon at its end; the default one without a file."""
    if not path:
        return DEFAULT
    lines = Path(path).read_text().splitlines()
    return "\n".join(x for x in lines if not x.lstrip().startswith("--")).strip().rstrip(";")


def run(spark: SparkSession, text: str) -> DataFrame:
    return spark.sql(text.strip().rstrip(";"))


def run_file(spark: SparkSession, data: str, path: str | None = None, names: str = "coded") -> DataFrame:
    register(spark, data, names)
    return run(spark, load(path))


def suite(path: str) -> list[str]:
    """The query files that a suite file names, one a line, relative to it; # begins a comment."""
    at = Path(path)
    lines = (x.split("#", 1)[0].strip() for x in at.read_text().splitlines())
    return [str(x if Path(x).is_absolute() else at.parent / x) for x in lines if x]


def benchmark(spark: SparkSession, data: str, files: Iterable[str], results: str, repetitions: int = 10, append: bool = False, names: str = "coded", log: str | None = None) -> list[tuple]:
    """Runs each file's query so often, planned anew each time, and writes a line of CSV for each run (times in milliseconds).

    log: a folder that gets a file for each query, with the time of each of its runs.
    """
    register(spark, data, names)
    device = f"{spark.sparkContext.master} x {spark.sparkContext.defaultParallelism}"
    fresh = not append or not Path(results).exists()
    out = []
    with open(results, "a" if append else "w", newline="") as f:
        write = csv.writer(f)
        if fresh:
            write.writerow(HEADER)
        for file in files:
            text, name = load(file), Path(file).name
            for i in range(1, repetitions + 1):
                begin = time.perf_counter()
                df = run(spark, text)
                df._jdf.queryExecution().executedPlan()
                planned = time.perf_counter()
                rows = len(df.collect())
                end = time.perf_counter()
                out.append((name, i, device, *(round(1000 * x, 3) for x in (end - begin, planned - begin, end - planned)), rows))
                write.writerow(out[-1])
            f.flush()
            if log:
                Path(log).mkdir(parents=True, exist_ok=True)
                (Path(log) / f"{Path(file).stem}.log").write_text("".join(f"{r[1]} {r[3]}\n" for r in out if r[0] == name))
    return out
