"""Vector search: exact cosine top-k of a query set against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import blocks

#: Query vectors of a block, and of a slice of it that is compared at once; rows of a task that meet a block at once.
BLOCK, SLICE, HELD = 1024, 32, 1 << 16


def dot(a: Column, b: Column) -> Column:
    """The inner product, summed in double precision: the cosine for unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def _pack(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([i for i, _ in rows]), np.array([v for _, v in rows])


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of a task's rows, HELD at a time."""
    ids: list[np.ndarray] = []
    rows: list[np.ndarray] = []
    for batch in batches:
        for start in range(0, batch.num_rows, HELD):
            part = batch.slice(start, HELD)
            ids.append(part.column(0).to_numpy(zero_copy_only=False))
            rows.append(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1))
            if sum(map(len, ids)) >= HELD:
                yield np.concatenate(ids), np.concatenate(rows)
                ids, rows = [], []
    if ids:
        yield np.concatenate(ids), np.concatenate(rows)


def _nearest(batches: Iterator[pa.RecordBatch], paths: tuple[str, ...], k: int) -> Iterator[pa.RecordBatch]:
    for own, rows in _held(batches):
        for path in paths:
            ids, matrix = blocks.read(path)
            for start in range(0, len(ids), SLICE):
                asked = ids[start : start + SLICE]
                scores = np.round(matrix[start : start + SLICE] @ rows.T, 9)
                scores[asked[:, None] == own[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(own, scores.shape), -scores))[:, :k]
                best = np.take_along_axis(scores, order, 1)
                keep = np.isfinite(best).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, order.shape[1])[keep]), pa.array(own[order].ravel()[keep]), pa.array(best.ravel()[keep])], names=["query_id", "id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id", vector_column: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, id, score and rank of the k nearest other rows of each query.

    Queries lie in the shared folder in blocks of bounded size. The rows are read once; HELD of a task's
    rows at a time meet one block after another and keep k rows for each query, so that k rows a query and
    task are shuffled and not all scores.
    """
    narrow = lambda df: df.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v")).where("v is not null")
    paths = blocks.write(narrow(queries), "query-vectors", block, _pack)
    found = narrow(vectors).mapInArrow(partial(_nearest, paths=paths, k=k), "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
