"""The corpus pipeline: stages that each apply one training-data operator to all documents their predecessor kept.

Quality rejects documents; near-duplicate components keep the document of least
identifier; contaminated documents go; personal data is replaced by its kind;
at last sources are mixed, and each document tells how many of its words the mix
takes. Nulls, empty tables and extra columns are handled as the operators state.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import common, decontaminate, mixing, near_duplicates, pii, quality


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.classified(docs, common.table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.masked(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, with their words (size), their source's target and the words it takes of each (repeats counted).

    Rows stay as they are, those without a key or that share one too; a column of docs that is called like one of the three new ones gets underscores.
    """
    mixed = mixing.mix(docs, carry=tuple(docs.columns))
    mixed = mixed.toDF(*(f"c{i}" for i in range(len(mixed.columns)))).where("c4 > 0")
    used, out = {"size", "target", "taken"}, []
    for i, c in enumerate(docs.columns):
        while c.lower() in used:
            c += "_"
        used.add(c.lower())
        out.append(F.col(f"c{i + 5}").alias(c))
    return mixed.select(*out, F.col("c1").alias("size"), F.col("c3").alias("target"), F.col("c4").alias("taken"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
]

ORACLE_SQL = None  # the quality model can't be said in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's rows are written and read again by the next."""
    docs = common.table(spark, sf_dir, "documents")
    where = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{where}/{i}-{name}")
            docs = spark.read.parquet(f"{where}/{i}-{name}")
    return docs
