"""The query library: star-schema suite and one query for each operator, with the same queries as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import files, operators, ssb

    return ssb.QUERIES | operators.QUERIES | files.QUERIES


def oracle_sql() -> dict[str, str]:
    from . import files, operators, ssb

    return ssb.SQL | operators.SQL | files.SQL
