"""python -m lodestar [QUERY.sql] --data DIR: runs a query, or a suite with --benchmark, over a data directory."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession

from . import sql
from .sources import text_sink


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lodestar", description=__doc__)
    p.add_argument("query", nargs="?", help="a file with one SQL query; without one the default query runs")
    p.add_argument("--data", required=True, help="the directory of the warehouse's Parquet tables")
    p.add_argument("--names", choices=("coded", "named"), default="coded", help="numbers or text for places, brands and months")
    p.add_argument("--text", help="writes the result as lines of text to this folder instead of printing it")
    p.add_argument("--explain", action="store_true", help="prints the plan, too")
    p.add_argument("--benchmark", metavar="SUITE", help="runs the queries of a suite file")
    p.add_argument("--results", default="results.csv", help="the CSV file of a benchmark")
    p.add_argument("--append", action="store_true", help="adds to the CSV file")
    p.add_argument("--repetitions", type=int, default=10)
    p.add_argument("--log", help="a folder for a log file of each query of a benchmark")
    p.add_argument("--master", help="the cluster; that of spark-submit or local[*] by default")
    o = p.parse_args(args)
    builder = SparkSession.builder.appName("lodestar").config("spark.sql.session.timeZone", "UTC")
    spark = (builder.master(o.master) if o.master else builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if o.benchmark:
        for name, i, _, total, *_ in sql.benchmark(spark, o.data, sql.suite(o.benchmark), o.results, o.repetitions, o.append, o.names, o.log):
            print(f"{name} {i}: {total} ms")
        return
    df = sql.run_file(spark, o.data, o.query, o.names)
    if o.explain:
        df.explain("formatted")
    if o.text:
        text_sink.write_text(df, f"{o.text}/{Path(o.query).stem if o.query else 'ad_hoc'}.res")
    else:
        df.show(1000, truncate=False)


if __name__ == "__main__":
    main()
