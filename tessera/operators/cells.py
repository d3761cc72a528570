"""A vector index of cells that finds the exact nearest rows.

Rows lie in the cell of their nearest centre, with their distance to it, in a table partitioned by cell; a log
beside it has the largest distance of each cell and write. As q·x = q·c + q·(x - c) <= q·c + |q| |x - c|, a cell can be passed over
when that bound for its radius falls short of the score that k rows of a query are known to reach, and so can
single rows by their own distance. The cells nearest to a query give that score; then only cells whose bound reaches
it are read. Rows can be appended; what an unfinished write left is not read, as only logged folders are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import blocks
from tessera.shared import materialize, shared_path

#: Rows that centres are fitted on, at most; centres at most; rounds of the fit.
SAMPLE, CELLS, ROUNDS = 1 << 15, 4096, 8
#: Queries of a block; rows that a task compares at once, and keeps k rows a query of.
BLOCK, HELD = 1024, 1 << 16
#: Cells that a query probes for its first score, and what rounding may add to a bound.
PROBE, SLACK = 4, 1e-6
ROWS, FOUND = "cell int, id long, v array<double>, away double", "query_id long, id long, score double"


@dataclass
class Index:
    folder: str
    centres: np.ndarray  # CELLS at most
    radii: np.ndarray  # below zero: an empty cell

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The most that any row of each cell can score with each query."""
        most = queries @ self.centres.T + np.linalg.norm(queries, axis=1)[:, None] * np.maximum(self.radii, 0)
        return np.where(self.radii >= 0, most + SLACK, -np.inf)


def fit(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, seed: int = 1) -> np.ndarray:
    """Centres by k-means on at most `sample` rows, those with the smallest hashes: about the square root of the number of all rows."""
    n = vectors.count()
    drawn = vectors.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < max(1, int((1 << 20) * min(1.0, sample / max(1, n))))).limit(sample)
    rows = np.array([r.v for r in drawn.orderBy(F.xxhash64("id"), "id").collect()], np.float64)
    if not len(rows):
        return np.zeros((1, 1))
    centres = rows[: min(cells or int(np.ceil(np.sqrt(n))), CELLS, len(rows))].copy()
    for _ in range(ROUNDS):
        own = _nearest_centre(rows, centres)[0]
        sums, counts = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, rows)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def _nearest_centre(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near = (np.square(centres).sum(axis=1) - 2 * rows @ centres.T).argmin(axis=1)
    return near, np.linalg.norm(rows - centres[near], axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _placed(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            near, away = _nearest_centre(_matrix(batch.column(1)), centres)
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), *batch.columns, pa.array(away)], names=["cell", "id", "v", "away"])


def narrow(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    return rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")


def _add(vectors: DataFrame, folder: str, centres: np.ndarray) -> None:
    path = shared_path(vectors.sparkSession, "cells-part")
    placed = vectors.mapInArrow(partial(_placed, centres=centres), ROWS)
    placed.repartition("cell").sortWithinPartitions("cell", "away").write.partitionBy("cell").parquet(path)
    written = vectors.sparkSession.read.schema(ROWS).parquet(path)
    # The log names the part; without its line the part does not count.
    written.groupBy("cell").agg(F.max("away").alias("radius")).withColumn("path", F.lit(path)).coalesce(1).write.mode("append").parquet(f"{folder}/log")


def build(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", cells: int | None = None) -> Index:
    vectors = narrow(rows, id_column, vector_column)
    folder, centres = shared_path(rows.sparkSession, "cells"), fit(vectors, cells)
    rows.sparkSession.createDataFrame([(n, c.tolist()) for n, c in enumerate(centres)], "cell int, v array<double>").write.parquet(f"{folder}/centres")
    _add(vectors, folder, centres)
    return load(rows.sparkSession, folder)


def append(index: Index, rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> Index:
    _add(narrow(rows, id_column, vector_column), index.folder, index.centres)
    return load(rows.sparkSession, index.folder)


def load(spark: SparkSession, folder: str) -> Index:
    centres = np.array([r.v for r in spark.read.parquet(f"{folder}/centres").orderBy("cell").collect()])  # CELLS at most
    radii = np.full(len(centres), -1.0)
    for r in spark.read.parquet(f"{folder}/log").groupBy("cell").agg(F.max("radius").alias("radius")).collect():
        radii[r.cell] = r.radius
    return Index(folder, centres, radii)


def _stored(spark: SparkSession, index: Index) -> DataFrame:
    paths = sorted(r.path for r in spark.read.parquet(f"{index.folder}/log").select("path").distinct().collect())  # one a write
    return reduce(DataFrame.unionByName, (spark.read.schema(ROWS).parquet(p) for p in paths))


def _pack(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors and least scores of a block of queries."""
    return np.array([i for i, _, _ in rows]), np.array([v for _, v, _ in rows]), np.array([s for _, _, s in rows])


def visited(index: Index, vectors: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether each query visits each cell: those whose bound reaches its least score, or the PROBE best bounds by centre if it has none."""
    near = vectors @ index.centres.T
    near[:, index.radii < 0] = -np.inf
    first = near >= np.sort(near, axis=1)[:, -min(PROBE, near.shape[1])][:, None]
    return np.where(np.isnan(least)[:, None], first & (index.radii >= 0), index.bounds(vectors) >= np.nan_to_num(least)[:, None])


def _compared(batches: Iterator[pa.RecordBatch], paths: tuple[str, ...], k: int, index: Index) -> Iterator[pa.RecordBatch]:
    """For each query the k best of the task's rows, of each HELD of them."""
    held: list[pa.RecordBatch] = []

    def best() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        cell, ids, away = (table.column(c).to_numpy() for c in ("cell", "id", "away"))
        rows = _matrix(table.column("v").chunk(0))
        for path in paths:
            query_ids, vectors, least = blocks.read(path)
            here = np.unique(cell)
            goes = visited(index, vectors, least)
            near, norm = vectors @ index.centres[here].T, np.linalg.norm(vectors, axis=1)
            for q in np.flatnonzero(goes[:, here].any(axis=1)):
                allowed = goes[q, cell]
                if not np.isnan(least[q]):
                    allowed &= near[q, np.searchsorted(here, cell)] + norm[q] * away + SLACK >= least[q]
                at = np.flatnonzero(allowed & (ids != query_ids[q]))
                scores = np.round(rows[at] @ vectors[q], 9)
                order = np.lexsort((ids[at], -scores))[:k]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(order), query_ids[q])), pa.array(ids[at][order]), pa.array(scores[order])], names=["query_id", "id", "score"])

    size = 0
    for batch in batches:
        for start in range(0, batch.num_rows, HELD):
            held.append(batch.slice(start, HELD))
            size += held[-1].num_rows
            if size >= HELD:
                yield from best()
                held.clear()
                size = 0
    if held:
        yield from best()


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(index: Index, queries: DataFrame, k: int, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, id, score and rank of the k rows of the index with the greatest inner product with each query, itself aside: all of them, exactly."""
    spark = queries.sparkSession
    asked = narrow(queries, id_column, vector_column)
    stored = _stored(spark, index).select("cell", "id", "v", "away")
    none = F.lit(None).cast("double")
    paths = blocks.write(asked.select("id", "v", F.lit(float("nan")).alias("least")), "cell-queries", BLOCK, _pack)
    first = _ranked(_among(stored, index, paths, k), k)
    # A query with fewer than k rows in the probed cells visits every cell.
    least = materialize(first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(none).alias("least")), "least")
    met = asked.join(least, asked["id"] == least["query_id"], "left").select("id", "v", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    paths = blocks.write(met, "cell-queries", BLOCK, _pack)
    return _ranked(_among(stored, index, paths, k), k)


def _visits(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            _, vectors, least = blocks.read(path)
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(visited(index, vectors, least).any(axis=0)), pa.int32())], names=["cell"])


def _among(stored: DataFrame, index: Index, paths: tuple[str, ...], k: int) -> DataFrame:
    spark = stored.sparkSession
    needed = spark.createDataFrame([(p,) for p in paths], "path string").mapInArrow(partial(_visits, index=index), "cell int").distinct()
    wanted = stored.where(F.col("cell").isin([r.cell for r in needed.collect()]))  # CELLS at most; folders of others are not read
    return wanted.mapInArrow(partial(_compared, paths=paths, k=k, index=index), FOUND)
