"""Members of zip archives by name, read and written by tasks: an archive is one row, a member is another."""

from __future__ import annotations

import fnmatch
import io
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def members(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """archive, name, size and content of the members, of all zip files below folder, whose names fit pattern."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(folder).select("path", "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for info in archive.infolist():
                        if not info.is_dir() and fnmatch.fnmatchcase(info.filename, pattern):
                            yield pd.DataFrame({"archive": [path], "name": [info.filename], "size": [info.file_size], "content": [archive.read(info)]})

    return files.mapInPandas(run, "archive string, name string, size long, content binary")


def write(rows: DataFrame, folder: str) -> None:
    """One zip file for each archive of rows (archive, name, content).

    A file appears whole under its archive's name; an attempt that is repeated replaces it by an equal one.
    """

    def run(own: pd.DataFrame) -> pd.DataFrame:
        name, packed = own["archive"].iloc[0], io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
            for member, content in sorted(zip(own["name"], own["content"], strict=True)):
                archive.writestr(zipfile.ZipInfo(member), content, zipfile.ZIP_DEFLATED)
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root)
        part = f"{root}/{name}.{uuid.uuid4().hex}.part"
        with fs.open_output_stream(part) as out:
            out.write(packed.getvalue())
        fs.move(part, f"{root}/{name}.zip")
        return pd.DataFrame({"archive": [name]})

    rows.groupBy("archive").applyInPandas(run, "archive string").write.format("noop").mode("overwrite").save()
