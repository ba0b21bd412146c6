"""Star joins: a dimension that only filters becomes a semi join, one that gives columns an inner join."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Dim:
    """A dimension with its key, the fact's foreign key, a filter and the columns wanted of it.

    unique: the key has one row each, as dimensions do; then a join that takes no
    column is a semi join. Duplicate keys keep SQL's meaning: set unique to False.
    """

    table: DataFrame
    key: str
    foreign: str
    where: Column | str | None = None
    columns: list[str] = field(default_factory=list)
    unique: bool = True


def star_join(fact: DataFrame, dims: list[Dim]) -> DataFrame:
    """fact joined to each dimension in turn, those that filter without columns first.

    No hint is given: Spark broadcasts a filtered dimension while it is under
    spark.sql.autoBroadcastJoinThreshold, by its statistics or, at run time, by its
    real size, and shuffles it beyond; AQE splits skewed keys then.
    """
    for d in sorted(dims, key=lambda d: (bool(d.columns), d.where is None)):
        t = d.table if d.where is None else d.table.where(d.where)
        on = F.col(d.foreign) == F.col(d.key)
        fact = fact.join(t.select(d.key), on, "left_semi") if d.unique and not d.columns else fact.join(t.select(d.key, *d.columns), on).drop(d.key)
    return fact
