"""Posting lists of trigrams: which texts may have a word somewhere within them.

The index has the texts of each trigram as lists, one for each stretch of a task's texts, in folders by a hash of the
trigram, so that a query reads only the folders of the trigrams it asks for. A text with a word has the word's rarest
trigram; those texts are the candidates, and the word is then looked for in them. Words of fewer than three letters
would need all texts and are not asked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import blocks
from tessera.functions.text import content_words
from tessera.operators import lexical
from tessera.shared import materialize, shared_path

#: Folders of postings; trigrams of a stretch of texts, whose lists are written together.
FOLDERS, HELD = 128, 1 << 22
#: Characters of a text that are cut into trigrams at once, so that a very long text needs no more memory than others.
PIECE = 1 << 20
#: Words of queries of a block.
WORDS = 1 << 16


@dataclass(frozen=True)
class Index:
    postings: str
    frequencies: str
    texts: str


def grams(text: str) -> np.ndarray:
    """The distinct trigrams of a text, its characters' code points as one number each."""
    found = np.zeros(0, np.int64)
    for start in range(0, len(text) - 2, PIECE):
        points = np.frombuffer(text[start : start + PIECE + 2].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        found = np.union1d(found, points[:-2] << 42 | points[1:-1] << 21 | points[2:])
    return found


def folder(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram and docs: the ids of a stretch of texts that have it; a stretch ends with HELD trigrams."""
    found: list[np.ndarray] = []
    owners: list[int] = []
    size = 0

    def lists() -> Iterator[pa.RecordBatch]:
        every, docs = np.concatenate(found), np.repeat(np.array(owners, np.int64), [len(f) for f in found])
        order = np.lexsort((docs, every))
        every, docs = every[order], docs[order]
        new = np.flatnonzero(np.diff(every, prepend=-1))
        ids = pa.ListArray.from_arrays(pa.array(np.append(new, len(every)), pa.int32()), pa.array(docs, pa.int64()))
        yield from pa.table({"gram": pa.array(every[new], pa.int64()), "docs": ids}).to_batches(max_chunksize=4096)

    for batch in batches:
        for doc, low in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if len(own := grams(low.as_py())):
                found.append(own)
                owners.append(doc)
                size += len(own)
            if size >= HELD:
                yield from lists()
                found, owners, size = [], [], 0
    if found:
        yield from lists()


def _by_gram(rows: list[tuple]) -> dict[int, list[str]]:
    found: dict[int, list[str]] = {}
    for gram, word in rows:
        found.setdefault(gram, []).append(word)
    return found


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word and gram for each trigram of words."""
    for batch in batches:
        words = batch.column(0).to_pylist()
        own = [grams(w) for w in words]
        if any(map(len, own)):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(words, object), [len(g) for g in own]), pa.string()), pa.array(np.concatenate(own), pa.int64())], names=["word", "gram"])


def build(docs: DataFrame, least: int, head: int = 120) -> Index:
    """The index of texts (doc_id, text) of at least so many characters."""
    path = shared_path(docs.sparkSession, "trigrams")
    index = Index(f"{path}/postings", f"{path}/frequencies", f"{path}/texts")
    low = docs.where((F.length("text") >= least) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.substring("text", 1, head).alias("head"), F.lower("text").alias("low"))
    texts = materialize(low, "texts", index.texts, "zstd")
    posted = texts.select("doc_id", "low").mapInArrow(_post, "gram long, docs array<long>").withColumn("folder", folder(F.col("gram")))
    posted.repartition("folder").sortWithinPartitions("folder", "gram").write.partitionBy("folder").parquet(index.postings)
    spark = docs.sparkSession
    materialize(spark.read.parquet(index.postings).groupBy("gram").agg(F.sum(F.size("docs")).alias("n")), "frequencies", index.frequencies)
    return index


def chosen(spark: SparkSession, index: Index, words: DataFrame) -> DataFrame:
    """word and gram: the rarest trigram of each word; words with a trigram that no text has are left out."""
    each = words.select("word").distinct().mapInArrow(_cut, "word string, gram long")
    told = each.join(spark.read.parquet(index.frequencies), "gram", "left")
    rarest = told.groupBy("word").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g"))
    return rarest.where("g.n > 0").select("word", F.col("g.gram").alias("gram"))


def candidates(spark: SparkSession, index: Index, asked: DataFrame) -> DataFrame:
    """doc_id and grams: which of the trigrams of asked (word, gram) a text has, of each text that has any."""
    folders = [r.folder for r in asked.select(folder(F.col("gram")).alias("folder")).distinct().collect()]  # FOLDERS at most
    posted = spark.read.parquet(index.postings).where(F.col("folder").isin(folders))
    each = posted.join(asked.select("gram").distinct(), "gram").select(F.explode("docs").alias("doc_id"), "gram")
    return each.groupBy("doc_id").agg(F.collect_set("gram").alias("grams"))


def containing(spark: SparkSession, index: Index, words: DataFrame) -> DataFrame:
    """doc_id, head and word for each text of the index and each of words (word) that is somewhere within it."""
    asked = materialize(chosen(spark, index, words), "rarest")
    each = candidates(spark, index, asked).select("doc_id", F.explode("grams").alias("gram")).join(asked, "gram")
    met = each.groupBy("doc_id").agg(F.collect_list("word").alias("words")).join(spark.read.parquet(index.texts), "doc_id")
    return met.select("doc_id", "head", F.explode(F.filter("words", lambda w: F.contains("low", w))).alias("word"))


def top_k(spark: SparkSession, index: Index, queries: DataFrame, k: int) -> DataFrame:
    """item_id, doc_id, score and rank: for each query (item_id, text) the k texts with most of its words, the first of each head.

    The index tells each text's trigrams that stand for words, and only those words are looked for in it; a task scores
    its texts and keeps k of them a query, as lexical.top_k does.
    """
    queried = materialize(queries.select(F.col("item_id").cast("long").alias("item_id"), content_words(F.col("text")).alias("words")).where("words IS NOT NULL"), "asked")
    asked = materialize(chosen(spark, index, queried.select(F.explode("words").alias("word"))), "rarest")
    rows = candidates(spark, index, asked).join(spark.read.parquet(index.texts), "doc_id").select("doc_id", "head", "low", "grams")
    return lexical.ranked(rows, lexical.blocks_of(queried, lexical.BLOCK), k, blocks.write(asked.select("gram", "word"), "rarest", WORDS, _by_gram))
