"""Lexical retrieval: the passages with most of a query's content words, one of each head."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import blocks
from tessera.functions.substrings import finder
from tessera.functions.text import content_words

#: Queries of a block; texts that meet a block at once; texts of all queries that a task keeps before it passes them on;
#: words that are looked for in a text one by one.
BLOCK, ROWS, HELD, ALONE = 2048, 512, 1 << 20, 64
FOUND = "item_id long, doc_id long, head string, score long"


def _pack(rows: list[tuple]) -> tuple[tuple[str, ...], list[np.ndarray], list[int]]:
    """The words of a block's queries, whose queries each is, and the queries' ids."""
    owners: dict[str, list[int]] = {}
    for n, (_, words) in enumerate(rows):
        for w in words:
            owners.setdefault(w, []).append(n)
    words = tuple(sorted(owners))
    return words, [np.array(owners[w]) for w in words], [i for i, _ in rows]


@lru_cache(maxsize=2)
def _queries(path: str) -> tuple:
    words, owners, ids = blocks.read(path)
    return finder(words), {w: n for n, w in enumerate(words)}, owners, ids


def _best(parts: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """Of (query, text's id, score, head's hash, head) columns: for each query the k best texts, one of each head."""
    query, ids, scores, marks, heads = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((ids, -scores, query))
    query, ids, scores, marks, heads = (c[order] for c in (query, ids, scores, marks, heads))
    # Stable, so that the first of each head is its best.
    by_head = np.lexsort((np.arange(len(query)), marks, query))
    new = np.ones(len(query), bool)
    new[1:] = (query[by_head][1:] != query[by_head][:-1]) | (marks[by_head][1:] != marks[by_head][:-1])
    kept = np.sort(by_head[new])
    edges = np.flatnonzero(np.diff(query[kept], prepend=-1))
    ranks = np.arange(len(kept)) - np.repeat(edges, np.diff(np.append(edges, len(kept))))
    return tuple(c[kept[ranks < k]] for c in (query, ids, scores, marks, heads))


def _scan(batches: Iterator[pa.RecordBatch], paths: tuple[str, ...], k: int, words: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    """The k best texts of the task for each query, once; more often only if they are over HELD together.

    Rows are doc_id, head and low; with words, the paths of what words each key of an index stands for, also the
    keys of each text, whose words alone are looked for in it, one by one; if they are over ALONE, one pass for all
    words of a block costs less.
    """
    stands: dict[int, list[str]] = {}
    for path in words:
        for g, own in blocks.read(path).items():
            stands.setdefault(g, []).extend(own)

    def alone(keys: list[int], low: str) -> list[str] | None:
        own = [w for g in keys for w in stands[g]]
        return [w for w in own if w in low] if len(own) <= ALONE else None

    held: dict[str, list[tuple[np.ndarray, ...]]] = {}

    def emit() -> Iterator[pa.RecordBatch]:
        for path, parts in held.items():
            query, doc_ids, scores, _, heads = _best(parts, k)
            items = np.array(_queries(path)[3])[query]
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(heads, pa.string()), pa.array(scores, pa.int64())], names=["item_id", "doc_id", "head", "score"])
        held.clear()

    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            doc_ids, lows = part.column(0).to_numpy(zero_copy_only=False), part.column(2).to_pylist()
            told = [alone(keys.values.tolist(), low) for keys, low in zip(part.column(3), lows, strict=True)] if words else [None] * len(lows)
            heads = np.array(part.column(1).to_pylist(), object)
            marks = np.fromiter(map(hash, heads), np.int64, len(heads))
            for path in paths:
                find, place, owners, ids = _queries(path)
                scores = np.zeros((len(lows), len(ids)), np.int32)
                for n, low in enumerate(lows):
                    if met := [owners[place[w]] for w in (find(low) if told[n] is None else told[n]) if w in place]:
                        scores[n] = np.bincount(np.concatenate(met), minlength=len(ids))
                row, query = np.nonzero(scores)
                if len(row):
                    here = (query, doc_ids[row], scores[row, query], marks[row], heads[row])
                    held[path] = [_best([*held.get(path, []), here], k)]
            if sum(len(p[0][0]) for p in held.values()) > HELD:
                yield from emit()
    yield from emit()


def top_k(docs: DataFrame, queries: DataFrame, k: int, least: int, head: int = 120, block: int = BLOCK) -> DataFrame:
    """item_id, doc_id, score and rank: for each query the k texts with most of its words, the first of each head.

    Queries (item_id, text) lie in the shared folder in blocks of bounded size. The texts are read once;
    a task scores its texts against one block after another and keeps k texts a query, so that no more
    than that is shuffled.
    """
    asked = queries.select(F.col("item_id").cast("long"), content_words(F.col("text")).alias("words")).where("words IS NOT NULL")
    rows = docs.where((F.length("text") >= least) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.substring("text", 1, head).alias("head"), F.lower("text").alias("low"))
    return ranked(rows, blocks_of(asked, block), k)


def blocks_of(asked: DataFrame, block: int) -> tuple[str, ...]:
    """Paths of blocks of queries (item_id, words)."""
    return blocks.write(asked, "queries", block, _pack)


def ranked(rows: DataFrame, paths: tuple[str, ...], k: int, words: tuple[str, ...] = ()) -> DataFrame:
    """item_id, doc_id, score and rank of texts (doc_id, head, low, and with words their keys in an index)."""
    found = rows.mapInArrow(partial(_scan, paths=paths, k=k, words=words), FOUND)
    first = Window.partitionBy("item_id", "head").orderBy(F.desc("score"), "doc_id")
    once = found.withColumn("n", F.row_number().over(first)).where("n = 1")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return once.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("item_id", "doc_id", "score", "rank")
