"""Deterministic sampling: hash orders instead of random ones, ranks per stratum, row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.shared import materialize


def order(key: str, seed: int) -> Column:
    """A seeded order that any engine can repeat."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))


def per_stratum(rows: DataFrame, strata: list[str], key: str, seed: int, most: int) -> DataFrame:
    """`most` rows of each stratum; Spark keeps no more than that many of a stratum in any task."""
    by = Window.partitionBy(*strata).orderBy(order(key, seed), key)
    return rows.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= most).drop("_n")


def balanced(rows: DataFrame, stratum: str, key: str, seed: int) -> DataFrame:
    """As many rows of each stratum as the smallest has."""
    least = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("_c")).agg(F.min("_c").alias("_least"))
    by = Window.partitionBy(stratum).orderBy(order(key, seed), key)
    ranked = rows.withColumn("_n", F.row_number().over(by))
    return ranked.join(F.broadcast(least), F.col("_n") <= F.col("_least")).drop("_n", "_least")  # one row


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """rows with n from 1 in the order of key, without one task for all: counts of ranges, then ranks within them.

    The ranges are written once with their numbers: read twice from an exchange they need not be cut alike.
    """
    spread = materialize(rows.repartitionByRange(key).withColumn("_p", F.spark_partition_id()), "ranges")
    counts = spread.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    first = counts.select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("_p").orderBy(key)
    return spread.withColumn("_r", F.row_number().over(within)).join(F.broadcast(first), "_p").withColumn("n", F.col("_first") + F.col("_r")).drop("_p", "_first", "_r")


def beside(rows: DataFrame, dump: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """rows with `name`: the value of the dump's row at the same place in the order of key; null everywhere if the dump has another length."""
    sizes = rows.agg(F.count(F.lit(1)).alias("_a")).join(dump.agg(F.count(F.lit(1)).alias("_b"))).select((F.col("_a") == F.col("_b")).alias("_same"))  # one row each
    there = numbered(dump.select(key, value), key).select("n", F.col(value).alias(name))
    met = numbered(rows, key).join(there, "n", "left").join(F.broadcast(sizes))
    return met.withColumn(name, F.when(F.col("_same"), F.col(name))).drop("n", "_same")
