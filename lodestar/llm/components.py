"""Connected components of links by local forests and alternating large-star and small-star steps, on the executors only.

Each task turns its links into stars of the same components, a link for each node
at most. Links that fit one task are done then, with no shuffle; of more, fewer
tasks take what is left as long as it shrinks, and the steps between all tasks do
the rest: minima are pre-aggregated and joined back, so a node with very many
links is a skewed join that Spark splits, never a collected group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, staged, tidy

#: Links that a task turns into stars at once.
TASK_LINKS = 1 << 18


def stars(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least node of its component, and the node, for each other node of links x, y."""
    nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = at[: len(x)], at[len(x) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new != (up := new[new])).any():
            new = up
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[own]], nodes[own]


def _forests(e: DataFrame, tasks: int, most: int) -> DataFrame:
    """Links (x, y) of the same components as those of e: stars of each most links that a task reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ys, size = [], [], 0

        def out() -> pa.RecordBatch:
            x, y = stars(np.concatenate(xs), np.concatenate(ys))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["x", "y"])

        for batch in batches:
            if size and size + batch.num_rows > most:
                yield out()
                xs, ys, size = [], [], 0
            xs.append(batch.column(0).to_numpy()), ys.append(batch.column(1).to_numpy())
            size += batch.num_rows
        if size:
            yield out()

    return e.select("x", "y").coalesce(tasks).mapInArrow(tidy(run), "x long, y long")


def _large(e: DataFrame) -> DataFrame:
    both = e.select(F.col("x").alias("u"), F.col("y").alias("v")).union(e.select(F.col("y").alias("u"), F.col("x").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("m").alias("x"), F.col("v").alias("y")).where("x < y").distinct()


def _small(e: DataFrame) -> DataFrame:
    low = e.groupBy("y").agg(F.min("x").alias("m"))
    far = e.join(low, "y").where("x <> m").select(F.least("x", "m").alias("x"), F.greatest("x", "m").alias("y"))
    return far.union(low.select(F.col("m").alias("x"), "y")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node and comp (the least node of its component) for each node that has links (x, y). The tables of the steps go."""
    with scratch(links.sparkSession) as kept:
        e = staged(links.where("x <> y").select("x", "y"), "links", small=True)
        n, tasks = e.count(), 0
        while tasks != 1:  # what one task has read is done
            tasks = max(1, -(-n // TASK_LINKS))
            e = staged(_forests(e, tasks, TASK_LINKS), "links", small=True)
            was, n = n, e.count()
            if n > TASK_LINKS and 2 * n > was:
                e = _steps(e)
                break
        # all ends in stars: every y has its component's least node as its x
        return kept(e.select(F.col("y").alias("node"), F.col("x").alias("comp")).union(e.select(F.col("x").alias("node"), F.col("x").alias("comp")).distinct()), "components", small=True)


def _steps(e: DataFrame) -> DataFrame:
    """The stars of the components of links (x, y)."""
    e = e.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    state = None
    while True:
        e = staged(_small(_large(e)), "links", small=True)
        now = tuple(e.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("x", "y")), F.lit(0))).first())
        if now == state or now[0] == 0:
            return e
        state = now
