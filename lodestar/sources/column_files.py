"""Raw column files: one file of little-endian 32-bit integers for each column, named TABLE and the column's number.

A file is read in records of as many values as divide its number, so files of any
size are split over tasks; the columns of a table are joined by record, not by value.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most values of a record.
RECORD = 1 << 16
_INPUT = "org.apache.spark.input.FixedLengthBinaryInputFormat"


def _file(spark: SparkSession, path: str) -> tuple:
    """A file's system and path in the JVM."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def values(spark: SparkSession, path: str) -> int:
    fs, p = _file(spark, path)
    size = fs.getFileStatus(p).getLen()
    if size % 4:
        raise ValueError(f"{path} isn't made of 32-bit integers")
    return size // 4


def _record(n: int) -> int:
    """The largest divisor of n up to RECORD."""
    small = [d for d in range(1, math.isqrt(n) + 1) if n % d == 0]
    return max((d for k in small for d in (k, n // k) if d <= RECORD), default=1)


def records(spark: SparkSession, path: str, name: str, size: int) -> DataFrame:
    """record and name: the bytes of each record of size values."""
    rdd = spark.sparkContext.newAPIHadoopFile(path, _INPUT, "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf={f"{_INPUT}.recordLength": str(4 * size)})
    return spark.createDataFrame(rdd, f"record long, {name} binary")


def read_table(spark: SparkSession, folder: str, table: str, columns: dict[int, str]) -> DataFrame:
    """The named columns (number: name) of a table, in no order; rows that a shorter column lacks are null there."""
    if not columns:
        raise ValueError("no column is asked for")
    paths = {name: f"{folder}/{table.upper()}{number}" for number, name in columns.items()}
    lengths = {name: values(spark, path) for name, path in paths.items()}
    names = list(columns.values())
    schema = ", ".join(f"{name} int" for name in names)
    filled = [n for n in lengths.values() if n]
    if not filled:
        return spark.createDataFrame([], schema)
    size = _record(math.gcd(*filled))
    parts = [records(spark, paths[name], name, size) for name in names if lengths[name]]
    whole = reduce(lambda a, b: a.join(b, "record", "full"), parts).select(*(F.col(n) if lengths[n] else F.lit(None).cast("binary").alias(n) for n in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                raw = [v.as_buffer() for v in row]
                n = max(b.size for b in raw if b is not None) // 4
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()) if b is None else pa.array(np.frombuffer(b, "<i4")) for b in raw], names=names)

    return whole.mapInArrow(run, schema)


def write_table(df: DataFrame, folder: str, table: str, order: str, numbers: list[int] | None = None) -> None:
    """The columns of df as files in the order of one of them. Each file is written in turn by the driver's JVM, one partition at a time."""
    spark = df.sparkSession
    columns = dict(zip(numbers or range(len(df.columns)), df.columns, strict=True))
    names = list(columns.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(c.cast(pa.int32()).to_numpy(), "<i4").tobytes()], pa.binary()) for c in batch.columns], names=names)

    blobs = df.orderBy(order).mapInArrow(run, ", ".join(f"{n} binary" for n in names))
    for number, name in columns.items():
        fs, p = _file(spark, f"{folder}/{table.upper()}{number}")
        out = fs.create(p)
        try:
            for row in blobs.select(name).toLocalIterator():
                out.write(row[0], 0, len(row[0]))
        finally:
            out.close()
