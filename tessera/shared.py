"""Session factory, table access and the folder that driver and executors share.

Intermediate tables are written there, never to a machine-local folder of a cluster, so that a
lost executor costs a re-read and not the lineage.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tessera", master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings the engine relies on (UTC, AQE); conf overrides any of them."""
    builder = SparkSession.builder.appName(app).master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows of a scan over all cores, if their files have fewer splits than there are cores; a table of any size has more."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows._jdf.queryExecution().toRdd().getNumPartitions() < cores else rows


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; in local mode without that setting, a temporary folder.

    Raises on a cluster without the setting: a machine-local folder would not be seen by all.
    """
    context = spark.sparkContext
    if configured := context.getConf().get("spark.checkpoint.dir"):
        return configured.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not (own := context.getConf().get("spark.tessera.localdir") or getattr(context, "_tessera_dir", None)):
        own = context._tessera_dir = tempfile.mkdtemp(prefix="tessera-")
    return own


#: Working tables made within scratch(), innermost last.
_made: list[list[str]] = []


def shared_path(spark: SparkSession, label: str) -> str:
    """A path below shared_dir that nothing has used yet."""
    path = f"{shared_dir(spark)}/tessera/{label}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    return path


def discard(path: str) -> None:
    """Delete a folder of the shared one, if it is there."""
    fs, root = pafs.FileSystem.from_uri(path)
    if fs.get_file_info(root).type == pafs.FileType.Directory:
        fs.delete_dir(root)


@contextmanager
def scratch() -> Iterator[None]:
    """On leaving, the folders that shared_path() gave within are deleted; what reads them must be written elsewhere by then."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            discard(path)


def materialize(df: DataFrame, label: str, path: str | None = None, codec: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, fixes generated row ids. codec: zstd for tables of texts."""
    spark = df.sparkSession
    path = path or shared_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
