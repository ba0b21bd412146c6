"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with SQL functions only.

Each source's target comes from its weight, and stops at a multiple of its size,
the excess being shared again by weight. A source takes whole epochs first; the
rest of its target is filled by the documents with the least exponential keys
-ln(u)/w, u drawn from a digest of the identifier and w the document's quality
weight, in the order of keys and as far as the prefix sum of sizes reaches: the
document at the boundary is taken if the sum then ends nearer to the target.

Prefix sums are made in two steps: keys are cut into ranges of some thousand
documents, the ranges' sums are added up, and only inside a range documents are
sorted. A source that holds most rows is thus dealt over many tasks. Targets are
made of one row for each source, which one task orders; sources are far fewer than
documents (a million of them are some ten megabytes there).

The weight is a column, for example a score of the quality classifier, or the
default of sized(). A weight that is null, not a number, or not over 0 counts as
LEAST, and one over 1 / LEAST as that.

Edge cases: null text has size 0, and size 0 takes 0; a null source is a source
of its own; a null key draws like an empty one; repeated rows draw equal keys and
are ordered by size, so the rows as a whole agree between runs; rows that share a
key are taken each for themselves; an empty table gives an empty mix; columns of any
name can be carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

#: Weights of the sources in the order of their names, repeating; share of all words that the mix has; most epochs.
WEIGHTS, SHARE, EPOCHS = (3, 1, 2), 1.5, 2
#: The least quality weight.
LEAST = 1e-6
#: Documents that one range of keys has on average.
RANGE = 4096


def sized(text: str = "text") -> tuple[F.Column, F.Column]:
    """Size (words of the text) and weight (of its quality, over 0).

    The weight is highest for words of ordinary length: very short or very long
    ones on average mark tables, hex or run-on text.
    """
    n = F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    mean = F.coalesce(F.length(text), F.lit(0)) / F.greatest(n, F.lit(1))
    return n, 1.0 / (1.0 + F.abs(mean - 6.0))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, docs, target of each source of sizes (source, source_size, docs).

    Water filling: in the order of limit over weight, sources stop at their limit
    until what is left, shared by weight, stops none of those that remain.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("cap", epochs * F.col("source_size"))
    order = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    run = (
        ranked.withColumn("budget", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("rest", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.col("left") / F.col("rest"))
    )
    # the level at the first source that isn't stopped holds for all that follow
    level = F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(every)["level"]
    return run.withColumn("target", F.coalesce(F.least(F.col("cap").cast("double"), F.col("w") * level), F.col("cap").cast("double"))).select("source", "source_size", "docs", "target")


def uniform(key: F.Column, seed: str) -> F.Column:
    """A number over 0 and under 1 from a digest of key."""
    n = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double")
    return (n + 0.5) / F.lit(float(1 << 48))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", carry: tuple[str, ...] = (), seed: str = "mix", weight: str | None = None, **rule: object) -> DataFrame:
    """key, size, source_size, target, taken, then carry, for each row of docs. weight: a column of quality weights."""
    size, own = sized(text)
    if weight is not None:
        w = F.col(weight).cast("double")
        own = F.when(w.isNull() | F.isnan(w), LEAST).otherwise(F.least(F.greatest(w, F.lit(LEAST)), F.lit(1 / LEAST)))
    small = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), size.alias("size"), own.alias("weight"), *(F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)))
    small = small.withColumn("es", -F.log(uniform(F.col("key"), seed)) / F.col("weight"))
    # what the sums are made of is written once; the carried columns are read when all is decided
    slim = staged(small.select("key", "source", "size", "es"), "mix")
    small = small if carry else slim
    sums = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    goal = staged(targets(sums, **rule), "mix-targets")
    full = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).cast("long")
    # 1 - exp(-key) is spread well enough over 0..1 for ranges; any monotone map is right
    bucket = F.floor((1 - F.exp(-F.col("es") * 0.5)) * F.ceil(F.col("docs") / F.lit(RANGE))).cast("long")

    def placed(rows: DataFrame) -> DataFrame:
        j = rows.join(goal.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_")
        return j.withColumn("full", full).withColumn("need", F.col("target") - F.col("full") * F.col("source_size")).withColumn("bucket", bucket)

    j = placed(small)
    per = placed(slim).groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("before", F.coalesce(F.sum("in_bucket").over(before), F.lit(0))).drop("in_bucket").withColumnsRenamed({"source": "source_", "bucket": "bucket_"})
    j = j.join(per, F.col("source").eqNullSafe(F.col("source_")) & (F.col("bucket") == F.col("bucket_"))).drop("source_", "bucket_")
    inside = Window.partitionBy("source", "bucket").orderBy("es", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    j = j.withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    once = F.when(F.col("at") + F.col("size") / 2 <= F.col("need"), F.col("size")).otherwise(0)
    return j.select(F.col("key").alias(key), "size", "source_size", "target", (F.col("full") * F.col("size") + once).alias("taken"), *(F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, length(coalesce(text, '')) AS chars FROM documents),
k AS (
  SELECT doc_id, source, size,
    -ln((CAST(CAST('0x' || substr(md5('mix' || CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0) / (1.0 / (1.0 + abs(chars / greatest(size, 1) - 6.0))) AS es FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY 1),
r AS (SELECT *, 2 * source_size AS cap, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM s),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 - CAST(coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / CAST(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM r),
v AS (SELECT level AS at_level FROM l WHERE level <= cap / w ORDER BY cap / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(CAST(cap AS DOUBLE), w * at_level), CAST(cap AS DOUBLE)) AS target FROM l LEFT JOIN v ON true),
j AS (
  SELECT k.doc_id, k.size, t.source_size, t.target, CAST(floor(t.target / greatest(t.source_size, 1)) AS BIGINT) AS f,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.es, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(f * size + CASE WHEN before + size / 2 <= target - f * source_size THEN size ELSE 0 END AS BIGINT) AS taken FROM j
"""
