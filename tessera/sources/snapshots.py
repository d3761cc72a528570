"""A keyed store of one snapshot and a log of changes, each a folder that counts once its version's manifest is there.

A version's manifest is a folder named by its number that is written in one go and never over another, so that of two writers of
one version the second fails, and what a lost writer left is not read. Readers see one version throughout. Compaction folds
the snapshot and the changes since into a new snapshot; older versions stay readable.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import logs

MANIFEST = "version long, kind string, path string"
SNAPSHOT, CHANGES = "snapshot", "changes"


class Store:
    def __init__(self, spark: SparkSession, folder: str, key: str) -> None:
        self.spark, self.folder, self.key = spark, folder, key

    def manifest(self) -> list[tuple[int, str, str]]:
        """version, kind and folder of all versions: one line each, as many as there were commits."""
        try:
            found = self.spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(f"{self.folder}/manifest")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return [tuple(r) for r in found.orderBy("version").collect()]

    def stage(self, rows: DataFrame, name: str) -> str:
        """Write rows to a folder of their own; nothing reads it before commit()."""
        path = f"{self.folder}/data/{name}"
        rows.write.parquet(path)
        return path

    def commit(self, version: int, kind: str, path: str) -> int:
        """Make the folder the store's version of that number; fails if there is one."""
        line = self.spark.createDataFrame([(version, kind, path)], MANIFEST).coalesce(1)
        line.write.mode("error").parquet(f"{self.folder}/manifest/{version:012d}")
        return version

    def _next(self) -> int:
        return max((v for v, *_ in self.manifest()), default=0) + 1

    def overwrite(self, rows: DataFrame) -> int:
        version = self._next()
        return self.commit(version, SNAPSHOT, self.stage(rows, f"{version:012d}-{SNAPSHOT}"))

    def upsert(self, rows: DataFrame) -> int:
        """Rows with new values of their keys; a null in every other column deletes the key."""
        version = self._next()
        return self.commit(version, CHANGES, self.stage(rows, f"{version:012d}-{CHANGES}"))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, or of the last: the snapshot before it and the last change of each key since, by one aggregate."""
        lines = [x for x in self.manifest() if version is None or x[0] <= version]
        if not any(kind == SNAPSHOT for _, kind, _ in lines):
            raise ValueError(f"no version {version} in {self.folder}")
        base = max(n for n, (_, kind, _) in enumerate(lines) if kind == SNAPSHOT)
        parts = [self.spark.read.parquet(path).withColumn("_v", F.lit(v)) for v, _, path in lines[base:]]
        every = reduce(DataFrame.unionByName, parts)
        if len(parts) == 1:
            return every.drop("_v")
        last = logs.latest(every, [self.key], ["_v"]).drop("_v")
        others = [c for c in last.columns if c != self.key]
        return last.where(F.coalesce(*(F.col(c).cast("string") for c in others)).isNotNull())

    def compact(self) -> int:
        """Fold the changes into a new snapshot, with the same rows; folders of older versions are left for their readers."""
        version = self._next()
        return self.commit(version, SNAPSHOT, self.stage(self.read(), f"{version:012d}-{SNAPSHOT}"))
