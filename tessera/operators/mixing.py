"""Training sets mixed by one rule: caps for each set and label, copies of small sets, an order by hash, missing sets skipped."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import sampling


@dataclass(frozen=True)
class Source:
    """A set of rows: where it lies, expressions of a row's id and label, rows of a label at most, copies."""

    name: str
    path: str
    id: str
    label: str
    cap: int | None = None
    copies: int = 1


def there(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None if nothing lies at its path."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def mix(spark: SparkSession, sources: list[Source], seed: int) -> DataFrame:
    """origin, id, label, copy and place (from 1, in the order of a seeded hash) of the rows that stay.

    Of each set and label the rows with the smallest hashes stay, so that a cap is no sample of the table's order; no
    task keeps more than the cap of a label. Places come from ranges of the hash.
    """
    parts = []
    for source in sources:
        if (rows := there(spark, source.path)) is None:
            continue
        own = rows.select(F.lit(source.name).alias("origin"), F.expr(source.id).cast("long").alias("id"), F.expr(source.label).cast("string").alias("label"))
        own = own.withColumn("h", F.md5(F.concat_ws("|", "origin", "id", F.lit(str(seed)))))
        if source.cap is not None:
            by = Window.partitionBy("label").orderBy("h", "id")
            own = own.withColumn("n", F.row_number().over(by)).where(F.col("n") <= source.cap).drop("n")
        parts.append(own.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(source.copies)))))
    if not parts:
        return spark.createDataFrame([], "origin string, id long, label string, copy int, place long")
    shuffled = reduce(DataFrame.unionByName, parts).withColumn("key", F.md5(F.concat_ws("|", "h", "copy")))
    return sampling.numbered(shuffled.drop("h"), "key").select("origin", "id", "label", "copy", F.col("n").cast("long").alias("place"))
