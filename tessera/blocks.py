"""Sets of queries as blocks of bounded size in the shared folder: written by tasks, read one after another by tasks."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessera.shared import materialize, shared_path


def _write(batches: Iterator[pa.RecordBatch], folder: str, size: int, pack: Callable[[list[tuple]], Any]) -> Iterator[pa.RecordBatch]:
    task, (fs, root) = TaskContext.get(), pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    paths: list[str] = []
    held: list[tuple] = []

    def flush() -> None:
        # An attempt's number is its own, so that what a lost attempt wrote is never read.
        name = f"{task.partitionId():06d}-{len(paths):04d}-{task.taskAttemptId()}"
        with fs.open_output_stream(f"{root}/{name}") as out:
            out.write(pickle.dumps(pack(held)))
        paths.append(f"{folder}/{name}")
        held.clear()

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.append(row)
            if len(held) == size:
                flush()
    if held:
        flush()
    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])


def write(rows: DataFrame, label: str, size: int, pack: Callable[[list[tuple]], Any]) -> tuple[str, ...]:
    """Paths of blocks of `size` rows at most, each as pack() makes it; the driver sees the paths alone."""
    folder = shared_path(rows.sparkSession, label)
    made = materialize(rows.mapInArrow(partial(_write, folder=folder, size=size, pack=pack), "path string"), f"{label}-paths")
    return tuple(sorted(r.path for r in made.collect()))


@lru_cache(maxsize=4)
def read(path: str) -> Any:
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as file:
        return pickle.loads(file.read())
