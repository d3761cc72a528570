"""Views over append-only logs: the latest state, runs of like records, what is not in a store yet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last record of each key, by an aggregate that combines before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*others), F.struct(*order)).alias("last")
    return rows.groupBy(*keys).agg(last).select(*keys, *(F.col(f"last.{c}").alias(c) for c in others))


def runs(rows: DataFrame, key: str, order: list[str], flag: str) -> DataFrame:
    """Maximal runs of records with an equal flag: since, n."""
    by = Window.partitionBy(key).orderBy(*order)
    turns = rows.withColumn("turn", F.coalesce((F.col(flag) != F.lag(flag).over(by)).cast("int"), F.lit(0)))
    return turns.withColumn("run", F.sum("turn").over(by)).groupBy(key, "run", flag).agg(F.min(order[0]).alias("since"), F.count(F.lit(1)).alias("n"))


def absent(new: DataFrame, store: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose keys the store does not have: insert-if-absent, and resuming."""
    return new.join(store.select(*keys).distinct(), keys, "left_anti")


def mixed(parts: list[DataFrame]) -> DataFrame:
    """All parts one after another, matched by column names."""
    return reduce(DataFrame.unionByName, parts)
