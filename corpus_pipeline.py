"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Texts are never shuffled: deduplication moves ids, digests and fingerprints, and its decisions are looked up
where the documents stand. Of what a stage writes to the shared folder only its result is left when it ends,
and only until the next stage has read it; the last stage's result stays for the caller to read and delete.

Edge cases: null and empty texts are scored like any other, are one group of copies and one of near copies, are
not contaminated, and pack as their end token; null and repeated ids are rows like others; where copies tie, the
smallest id, then the first row stays; a very long text is scored, hashed, searched and packed whole; extra
columns pass through all stages but the last, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, exact_dedup, packing, quality, simhash
from tessera.llm.common import keyed
from tessera.llm.queries import tokenizer_path
from tessera.shared import discard, materialize, scratch, shared_path, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.with_scores(docs, model).where(F.col(quality.SCORE) >= quality.THRESHOLD).select(*docs.columns)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The longest original of equal texts."""
    return exact_dedup.drop_duplicates(keyed(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints."""
    return simhash.drop_near_duplicates(keyed(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in the benchmark."""
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~decontaminate.contaminated()).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    found = packing.pack(packing.pieces(docs, tokenizer_path()))
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_duplicates),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", packed),
]

#: Compression, fingerprints and tokens have no SQL form; the tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_path(spark, name.replace(" ", "-"))
        with scratch():
            docs = materialize(stage(spark, docs, sf_dir), name, path)
        if before:
            discard(before)
        before = path
    return docs
