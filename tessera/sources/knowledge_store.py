"""Knowledge stores: files of concatenated JSON objects {url, url2text: [sentence]}, with raw line breaks in strings."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text

DECODED = "path string, n long, url string, passage string"


def records(content: str) -> Iterator[dict]:
    """The objects in content, one after another; a truncated last one is left out."""
    decoder, at = json.JSONDecoder(strict=False), 0
    while at < len(content):
        if content[at].isspace():
            at += 1
            continue
        try:
            found, at = decoder.raw_decode(content, at)
        except json.JSONDecodeError:
            return
        if isinstance(found, dict):
            yield found


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = [(r.get("url") or "", p.strip()) for r in records(content.decode("utf-8", "replace")) for p in r.get("url2text") or () if p and p.strip()]
            for at in range(0, len(rows), 4096):
                part = rows[at : at + 4096]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(part), pa.string()), pa.array(range(at, at + len(part)), pa.int64()), pa.array([u for u, _ in part], pa.string()), pa.array([p for _, p in part], pa.string())], names=["path", "n", "url", "passage"])


def passages(spark: SparkSession, path: str) -> DataFrame:
    """path, n, url, passage and domain of every passage; a claim's file is one record of the scan."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_decode, DECODED).withColumn("domain", text.domain(F.col("url"), "knowledge-store"))
