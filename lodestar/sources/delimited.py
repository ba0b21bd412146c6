"""Lines of values with a delimiter between them and, as bulk loaders write them, one behind the last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write(df: DataFrame, path: str, delimiter: str = "|") -> None:
    """Part files without header; NULL is an empty value."""
    df.select(F.concat(F.concat_ws(delimiter, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)), F.lit(delimiter)).alias("value")).write.text(path)


def read(spark: SparkSession, path: str, schema: str, delimiter: str = "|", trailing: bool = True) -> DataFrame:
    """The columns of schema (DDL); a line that doesn't fit it raises. trailing: each line ends with the delimiter."""
    whole = f"{schema}, end_of_line STRING" if trailing else schema
    out = spark.read.csv(path, schema=whole, sep=delimiter, header=False, mode="FAILFAST", nullValue="")
    return out.drop("end_of_line")
