"""Structured Streaming over files: hourly windows with a watermark, deduplication within it, the audit log, a bounded shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, schema: str, files: int = 1) -> DataFrame:
    """A stream of Parquet files; ts becomes a timestamp, which watermarks need."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    return rows.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("hour"), "event_type", "n", "total")


def once(rows: DataFrame, keys: list[str], late: str = "7 days") -> DataFrame:
    """The first record of each key within the watermark: a cache with a time to live."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


#: A record of the audit log.
AUDIT = "ts timestamp, herramienta string, argumento string, decision string, modo string, aprobado_por string, exito boolean, hash_resultado string"


def audit(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """The append-only audit log as a stream; a line that is no record gives nulls and is left out."""
    return spark.readStream.schema(AUDIT).option("maxFilesPerTrigger", files).json(folder).where("herramienta IS NOT NULL")


def decisions(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """Decisions by tool and hour, as the log grows."""
    return rows.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "herramienta", "decision").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("hour"), "herramienta", "decision", "n")


def shuffled(rows: DataFrame, buffer: int, seed: int) -> DataFrame:
    """rows in another order within each task, through a buffer of so many rows: each row that comes in sends one out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        held: pa.Table | None = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            if (over := held.num_rows - buffer) > 0:
                order = rng.permutation(held.num_rows)
                yield from held.take(order[:over]).to_batches()
                held = held.take(order[over:]).combine_chunks()
        if held is not None and held.num_rows:
            yield from held.take(rng.permutation(held.num_rows)).to_batches()

    return rows.mapInArrow(run, rows.schema)
