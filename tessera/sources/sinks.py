"""Append-only stores: records, rows that are not there yet, the latest row of a key, pairs by model, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tessera.operators import logs


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def append_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line; null fields are left out."""
    rows.write.mode("append").json(path)


def append_absent(rows: DataFrame, path: str, keys: list[str], partition: list[str] | None = None) -> None:
    """Rows whose keys the store does not have, one of each key: what a job that is run again has left to do."""
    store = _stored(rows.sparkSession, path)
    new = rows.dropDuplicates(keys) if store is None else logs.absent(rows.dropDuplicates(keys), store, keys)
    new.write.mode("append").partitionBy(*(partition or [])).parquet(path)


def latest(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """The view of a log in which a later row of a key replaces the earlier ones."""
    return logs.latest(spark.read.parquet(path), keys, order)


def reports(rows: DataFrame, key: str) -> DataFrame:
    """key and report: each row as one JSON object."""
    return rows.select(key, F.to_json(F.struct(*rows.columns)).alias("report"))
